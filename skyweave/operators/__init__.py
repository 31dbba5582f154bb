"""DataFrame -> DataFrame operators on keyed series."""
