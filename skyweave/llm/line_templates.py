"""Lines that recur across documents, found by a log-template tree of fixed depth, in DataFrame operations only.

The tree: the number of tokens of a line, then its leading tokens; a token with a digit counts as a variable field. In a leaf a
token is constant at its position if enough documents agree on it, else it is a variable field; lines with the
same constants are one template.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.session import stage_table

from .jaccard_join import components

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
BITS = 1 << 23
TURN = 0x2AAAAAAAAAAAAAAA
MINIMA = ["m1", "m2", "m3", "m4"]


def _tokens(line: Column, words: Column) -> Column:
    """Tokens of a line, those with a digit as a field; ``words``: the line cut at blanks."""
    masked = F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
    masked = F.when(line.rlike("[0-9]"), masked).otherwise(line)
    # most lines hold single blanks and no digit: they are cut without a pattern
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[0-9\x09-\x0D]")
    return F.when(odd, F.split(F.btrim(masked, F.lit(" \t\n\x0b\x0c\r")), SPACE)).otherwise(words)


def _fixed() -> Column:
    """Tokens of a line that are no field."""
    return F.when(F.array_contains("tokens", FIELD), F.size(F.filter("tokens", lambda w: w != FIELD))).otherwise(F.size("tokens"))


def _minima(words: Column) -> Column:
    """Per line (its words, cut at blanks) four minima of the hashes of its runs of four words; a shorter line is one run."""
    # a transform each, so that what is used several times is computed once
    pairs = F.transform(words, lambda w: F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.xxhash64(a, b)))
    runs = F.transform(pairs, lambda p: F.slice(F.zip_with(p, F.slice(p, 3, 1 << 30), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(p) - 3, F.lit(1))))
    # least and greatest, and the least and greatest by another order
    turned = F.transform(runs, lambda r: F.struct(r.alias("r"), F.transform(r, lambda h: h.bitwiseXOR(F.lit(TURN))).alias("t")))
    return F.transform(turned, lambda x: F.struct(F.array_min(x["r"]).alias("m1"), F.bitwise_not(F.array_max(x["r"])).alias("m2"), F.array_min(x["t"]).alias("m3"), F.bitwise_not(F.array_max(x["t"])).alias("m4")))


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _split(docs: DataFrame, columns: list, minima: bool = False) -> DataFrame:
    """A row per line with a token."""
    # what is computed once per text or line has to stand below the generator: above it, every use computes it again
    cut = F.split("text", "\n")
    texts = docs.where("text is not null")
    if minima:
        # columns of their own: the optimizer leaves apart what is expensive and used twice, so that a line is cut at blanks once
        texts = texts.select(*columns, cut.alias("cut")).select("*", F.transform("cut", lambda x: F.split(x, " ")).alias("words"))
        lines = F.zip_with(F.zip_with("cut", "words", _tokens), _minima(F.col("words")), lambda a, m: F.struct(a.alias("tokens"), *[m[k].alias(k) for k in MINIMA]))
        texts = texts.select("*", lines.alias("lines")).drop("cut", "words")
    else:
        texts = texts.select(*columns, F.transform(cut, lambda x: _tokens(x, F.split(x, " "))).alias("lines"))
    # outer: a plain explode infers a filter on the array, which cuts every text again; there are no null arrays here
    lines = texts.select("*", F.posexplode_outer("lines").alias("line_no", "line" if minima else "tokens")).drop("lines")
    if minima:
        lines = lines.select("*", "line.*").drop("line")
    return lines.withColumn("n", F.size("tokens")).where(F.get("tokens", F.lit(0)) != "")


def _with_leaf(lines: DataFrame, depth: int) -> DataFrame:
    """Leaf of the tree, and two hashes of the line's form."""
    lead = [F.get("tokens", F.lit(i)) for i in range(depth)]
    return lines.select("*", F.xxhash64("n", *lead).alias("leaf"), F.xxhash64("tokens").alias("f1"), F.xxhash64(F.lit(1), "tokens").alias("f2"))


def _bitmap(df: DataFrame, column: str) -> Column:
    """2^23 bits, those of the column's values set, as a scalar subquery over a stored row of 2^17 numbers.

    One row of 2^20 bytes whatever the size; no plan carries it, as Spark keeps the text of finished plans.
    """
    words = df.groupBy(F.expr(f"shiftright({column} & {BITS - 1}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("b"))
    every = df.sparkSession.range(BITS >> 6).withColumnRenamed("id", "w").join(words, "w", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("bits"))
    return stage_table(row.select(F.col("bits.b").alias("bits")), "template-bits").scalar()


def _held(bitmap: Column, column: str) -> Column:
    """Whether the value's bit is set."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    word = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0


def _one_text_each(forms: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """h1 of the text that stands for each form longer than ``depth`` in the leaves."""
    return forms.where(F.col("n") > depth).join(leaves, "leaf", "left_semi").select(F.col("held_by").alias("h1"))


def _generalised(docs: DataFrame, forms: DataFrame, depth: int, least: int, share: float) -> DataFrame:
    """Template of every form in a leaf that holds several: t1, t2, and its constants."""
    leaves = forms.where(F.col("n") > depth).groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("texts").alias("texts")).where((F.col("forms") > 1) & (F.col("texts") >= least))
    leaves = stage_table(leaves.select("leaf"), "template-leaves")
    # one text of each form gives its tokens: only these are cut again; a clash of bits cuts a text more
    texts = docs.select("text", _text_keys()[0]).where(_held(_bitmap(_one_text_each(forms, leaves, depth), "h1"), "h1"))
    lines = _with_leaf(_split(texts, []), depth).where(_held(_bitmap(leaves, "leaf"), "leaf"))
    known = forms.select("f1", "f2", "texts")
    lines = lines.select("leaf", "f1", "f2", "n", "tokens").dropDuplicates(["f1", "f2"]).join(leaves, "leaf", "left_semi").join(known, ["f1", "f2"])
    cells = stage_table(lines.select("leaf", "f1", "f2", "n", "texts", F.posexplode("tokens").alias("at", "token")).select("leaf", "f1", "f2", "n", "texts", "at", F.when(F.col("token") != FIELD, F.xxhash64("token")).alias("token")), "template-cells")
    common = cells.where("token is not null").groupBy("leaf", "at", "token").agg(F.sum("texts").alias("support")).where(F.col("support") >= least).select("leaf", "at", "token", F.lit(True).alias("constant"))
    flagged = cells.join(common, ["leaf", "at", "token"], "left")
    constant = [F.when(F.col("constant"), F.xxhash64(F.lit(k), "at", "token")) for k in (3, 4)]
    found = flagged.groupBy("leaf", "f1", "f2", "n").agg(F.bit_xor(constant[0]).alias("x1"), F.bit_xor(constant[1]).alias("x2"), F.count("constant").alias("constants"))
    found = found.where(F.col("constants") >= share * F.col("n"))
    return found.select("f1", "f2", F.xxhash64("leaf", "x1").alias("t1"), F.xxhash64("leaf", "x2").alias("t2"), F.col("constants").alias("t_constants"))


def _groups(texts: DataFrame) -> DataFrame:
    """``h1`` and ``group`` of every text that agrees with another one in two of its minima, the same for all that hang together."""
    bands = [F.struct(F.lit(i).alias("i"), F.xxhash64(a, b).alias("v")) for i, (a, b) in enumerate(combinations(MINIMA, 2))]
    bands = texts.select("h1", F.inline(F.array(*bands)))
    heads = bands.groupBy("i", "v").agg(F.min("h1").alias("head"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    links = bands.join(heads, ["i", "v"]).where("h1 <> head").select(F.col("h1").alias("a"), F.col("head").alias("b"))
    return components(links).select(F.col("node").alias("h1"), F.col("comp").alias("group"))


def recurring_lines(docs: DataFrame, depth: int = 3, least: int = 3, share: float = 0.75, constants: int = 3, own: int = 7) -> DataFrame:
    """Lines to drop: h1, h2 (hash of the text), line_no."""
    lines = _with_leaf(_split(docs, ["doc_id", *_text_keys()], minima=True), depth)
    lines = lines.select("h1", "h2", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), "line_no", "n", _fixed().alias("fixed"), "leaf", "f1", "f2", *MINIMA)
    lines = stage_table(lines, "template-lines")
    # equal texts are one: a line counts once for all copies of its document
    held = lines.groupBy("f1", "f2", "h1", "h2").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("fixed").alias("fixed"))
    forms = stage_table(held.groupBy("f1", "f2").agg(F.count("*").alias("texts"), F.min("h1").alias("held_by"), F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("fixed").alias("fixed")), "template-forms")
    wide = stage_table(_generalised(docs, forms, depth, least, share), "templates")
    exact = forms.where((F.col("texts") >= least) & (F.col("fixed") >= share * F.col("n")))
    forms = exact.select("f1", "f2", "fixed").join(wide, ["f1", "f2"], "full")
    forms = forms.select("f1", "f2", F.coalesce("t1", "f1").alias("t1"), F.coalesce("t2", "f2").alias("t2"), F.coalesce("t_constants", F.col("fixed").cast("bigint")).alias("constants")).where(F.col("constants") >= constants)
    forms = stage_table(forms.drop("constants"), "template-candidates")
    # the bitmap spares lines of no template the shuffle; the join is exact
    bits = _bitmap(forms, "f1")
    words = [*[F.col(c) for c in ("h1", "h2", "n")], *[F.col(m) for m in MINIMA]]
    at = stage_table(lines.where(_held(bits, "f1")).join(forms, ["f1", "f2"], "left").select(*words, "doc", "line_no", "t1", "t2"), "template-places")
    every = lines.where(~_held(bits, "f1")).select(*words, F.lit(True).alias("rest")).union(at.select(*words, F.col("t1").isNull()))
    every = every.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rest"), F.col("n"))).alias("own"), F.bool_and("rest").alias("none"), *[F.min(m).alias(m) for m in MINIMA], *[F.min(F.when(F.col("rest"), F.col(m))).alias(f"own_{m}") for m in MINIMA])
    kept = F.coalesce(own * F.col("own") >= F.col("n"), F.lit(False))
    every = every.where("not none").select("h1", *[F.when(kept, F.col(f"own_{m}")).otherwise(F.col(m)).alias(m) for m in MINIMA])
    # stored before it is read several times, so that the bitmap stands in no other plan
    groups = _groups(stage_table(every, "template-texts"))
    at = at.where("t1 is not null")
    place = F.struct("doc", "h1", "h2", "line_no")
    texts = at.groupBy("t1", "t2", "h1", "h2").agg(F.min(place).alias("first")).join(groups, "h1", "left")
    texts = texts.groupBy("t1", "t2", F.coalesce("group", "h1").alias("group")).agg(F.min("first").alias("first"))
    templates = texts.groupBy("t1", "t2").agg(F.count("*").alias("groups"), F.min("first").alias("first")).where(F.col("groups") >= least)
    first = templates.select("t1", "t2", F.col("first.h1").alias("o1"), F.col("first.h2").alias("o2"), F.col("first.line_no").alias("first_line"))
    stays = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("line_no") == F.col("first_line"))
    return at.join(first, ["t1", "t2"]).where(~stays).select("h1", "h2", "line_no")


def drop_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``document`` (a struct of all columns, the text as it came), ``text`` without recurring lines, ``n_lines``, ``n_dropped``.

    Lines end at U+000A, tokens are runs other than U+0020 and U+0009 to U+000D. Options: ``depth`` leading tokens of the tree;
    a token is constant in its leaf, and a template recurs, if at least ``least`` different texts hold it; at least
    ``share`` of a template's tokens and ``constants`` of them are constant, so that lines which agree in a few common words are
    no template. The first occurrence (least ``doc_id``, then text hash and line) stays, so that no content is lost.

    Copies of documents are not boilerplate: equal texts count once, and near copies of one document are one group. Texts are
    grouped that agree in two of four minima (hashes of runs of four words), over what is left of a text without lines of candidate
    templates; if that is less than a part in ``own`` of its words, all lines that it shares make it a near copy (three quarters of
    the runs in common) and the minima are those of the whole text. A template is dropped if ``least`` groups hold it, counted exactly.

    Null text: null, no lines. Lines without tokens stay. A text of which all lines go is empty. Null ``doc_id``: counts as the
    largest. Repeated rows: treated alike. An empty table gives no rows. Narrow tables are stored in the shared folder.
    """
    gone = recurring_lines(docs, **options).distinct().groupBy("h1", "h2").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text", *_text_keys()).join(gone, ["h1", "h2"], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return rows.select("document", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
