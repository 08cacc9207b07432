"""Line dedup with a log-template tree of fixed depth. DataFrame and SQL functions only.

A line's path in the tree is its token count and its LEADING leading tokens; tokens that hold a digit (numbers, dates, ids) are
variable from the start and read <*>. In each leaf a token stands for itself where MIN_DOCS documents or more have it at that
place, and is a variable field where fewer have; the line with its fields masked is its template if more than half of its tokens,
and three at least, are left. Else, and for lines of LONG tokens or more (passages of prose), the line itself with its digit tokens
masked is the template. Two lines are of one template if token count, leading tokens (32-bit hash) and the rest (64-bit hash) agree.

A template recurs, and all its lines go, if MIN_DOCS documents that aren't copies of each other hold it; LONG_DOCS for lines of LONG
tokens or more. Lines of fewer than MIN_TOKENS tokens (none or one word) stay. Copies count once: equal texts, and texts that are linked, also over
others. Two texts that hold a candidate template in common are linked if the ends of lines (leading and last tokens, with the rough length of the line as
weight) that are found in both make up three quarters of those found in either: an edit inside a line leaves its ends, other lines around a
shared passage don't have them in common.

No link is lost, and no template's texts are paired with each other: ends are ranked by how many texts have them, and two linked texts share one among
the rarest ends that make up a quarter of each one's weight. Pairs are looked for there only. Where more than CROWD texts
have such an end, all are compared with one of them first; then only those still in different groups, and of these only pairs whose distances from
that one differ by a quarter at most (the share not in common is a metric).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import components, few, materialize, scratch

MIN_DOCS, MIN_TOKENS, LEADING = 5, 2, 2
#: Lines of LONG tokens or more have no fields but tokens with a digit, and recur from LONG_DOCS documents on.
LONG, LONG_DOCS = 50, 2
#: Texts with one rare end up to which all pairs are compared.
CROWD = 24
#: The low bits of a line's end hold the length of the line, as half powers of two.
_SIZE = 255
#: A token with a digit, from the token's first character on.
_VARIABLE = r"(?<![^ \t\x0b\f\r\n])[^ \t\x0b\f\r\n0-9]*+[0-9][^ \t\x0b\f\r\n]*"
_LEAF = ["n_tokens", "lead"]
_NODE = [*_LEAF, "leaf"]
_TEMPLATE = [*_LEAF, "template"]


def masked_lines(text: Column) -> Column:
    """The lines of a text with digit tokens masked and tokens joined by one space."""
    # Most texts hold no digit, or no blank but single spaces; asking first is much cheaper than replacing nothing.
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _VARIABLE, "<*>")).otherwise(text)
    blank = F.when(text.rlike(r"[\t\x0b\f\r]|  "), F.regexp_replace(masked, r"[ \t\x0b\f\r]+", " ")).otherwise(masked)
    return F.transform(F.split(blank, "\n", -1), lambda x: F.trim(x))


def _tokens(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + F.when(x == "", 0).otherwise(1)).cast("int")


def line_ends(lines: Column) -> Column:
    """Hashes (24 bits) of the distinct ends of the lines, each with the rough length of its line in the low bits."""

    def ends(x):
        size = F.round(2 * F.log2(_tokens(x))).cast("int")
        end = lambda tag, n: F.shiftleft(F.hash(F.lit(tag), F.substring_index(x, " ", n)), 8).bitwiseOR(size)
        return F.array(end("first", LEADING), end("last", -LEADING))

    return F.array_distinct(F.flatten(F.transform(F.filter(lines, lambda x: x != ""), ends)))


def _end_weight(end: Column) -> Column:
    return F.floor(16 * F.pow(F.lit(2.0), end.bitwiseAND(F.lit(_SIZE)) / 2))


def weight(ends: Column) -> Column:
    """Sum of the line lengths that go with ends, in sixteenths of a token."""
    return F.aggregate(ends, F.lit(0).cast("bigint"), lambda s, x: s + _end_weight(x))


def parsed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """uid, text_hash, doc_id, text, parts (line ends), their weight, and lines of every row: each line's tokens, its node (null if too short) and what follows the leading tokens.

    uid tells rows apart within one materialized copy. carry puts row, the whole row as a struct, in the place of doc_id and text.
    """
    own = [F.struct("*").alias("row")] if carry else [F.col("doc_id"), F.col("text")]
    text = F.coalesce("text", F.lit(""))

    def line(x):
        tokens = _tokens(x)
        node = F.struct(tokens.alias("n_tokens"), F.hash(F.substring_index(x, " ", LEADING)).alias("lead"), F.xxhash64(x).alias("leaf"))
        rest = F.transform(F.slice(F.split(x, " "), LEADING + 1, LONG), lambda t: F.hash(t))
        return F.struct(tokens.alias("tokens"), F.when(tokens >= MIN_TOKENS, node).alias("node"), F.when((tokens > LEADING) & (tokens < LONG), rest).alias("rest"))

    head = docs.select(F.monotonically_increasing_id().alias("uid"), F.xxhash64("text").alias("text_hash"), *own, masked_lines(text).alias("_m"))
    return head.select(*[c for c in head.columns if c != "_m"], line_ends(F.col("_m")).alias("parts"), F.transform("_m", line).alias("lines")).withColumn("weight", weight(F.col("parts")))


def _enough(min_docs: int) -> Column:
    return F.when(F.col("n_tokens") >= LONG, min(LONG_DOCS, min_docs)).otherwise(min_docs)


def _templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """The nodes of templates that min_docs rows or more hold, each with its template."""
    own = lines.select(F.sort_array(F.filter(F.transform("lines", lambda x: x["node"]), lambda n: n.isNotNull())).alias("_s"))
    once = own.select(F.explode(F.filter("_s", lambda x, i: (i == 0) | (x != F.col("_s")[i - 1]))).alias("node")).select("node.*")
    counts = materialize(once.groupBy(*_NODE).agg(F.count("*").alias("n")), "nodes")
    # Leaves with several lines: a token that min_docs documents have at its place stays, others are fields.
    varied = counts.where((F.col("n_tokens") > LEADING) & (F.col("n_tokens") < LONG)).groupBy(*_LEAF).agg(F.sum("n").alias("rows"), F.count("*").alias("forms")).where((F.col("rows") >= min_docs) & (F.col("forms") > 1))
    some = materialize(counts.join(varied.select(*_LEAF), _LEAF), "varied")
    every = lines.select(F.explode("lines").alias("x")).where("x.rest IS NOT NULL").select("x.node.*", "x.rest")
    forms = materialize(every.join(few(some), _NODE).groupBy(*_NODE, "n").agg(F.first("rest").alias("rest")), "forms")
    placed = forms.select(*_NODE, "n", F.posexplode("rest").alias("at", "token"))
    steady = placed.groupBy(*_LEAF, "at", "token").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_docs).select(*_LEAF, "at", "token", F.lit(True).alias("steady"))
    told = placed.join(steady, [*_LEAF, "at", "token"], "left").groupBy(*_NODE, "n").agg(F.array_sort(F.collect_list(F.when(F.col("steady"), F.struct("at", "token")))).alias("_k"))
    held = LEADING + F.size("_k")
    fields = told.where((held < F.col("n_tokens")) & (2 * held > F.col("n_tokens")) & (held >= 3)).select(*_NODE, "n", F.xxhash64("_k").alias("template"))
    fields = materialize(fields, "fields")
    broad = fields.groupBy(*_TEMPLATE).agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_docs).select(*_TEMPLATE)
    plain = counts.where(F.col("n") >= _enough(min_docs)).join(fields.select(*_NODE), _NODE, "left_anti").select(*_NODE, F.col("leaf").alias("template"))
    return materialize(plain.unionByName(fields.join(broad, _TEMPLATE).select(*_NODE, "template")), "templates")


def _sizes_fit(a: str, b: str) -> str:
    """What two texts share is no more than the lighter one, what either has no less than the heavier one."""
    return f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})"


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b), each once, with apart, the share of what either has that isn't in both, and alike, whether they are linked."""
    side = lambda c: nodes.select(F.col("h").alias(c), F.col("parts").alias(f"p{c}"), F.col("held").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared, all_ = weight(F.array_intersect("pa", "pb")), weight(F.col("pa")) + weight(F.col("pb"))
    told = both.select("a", "b", shared.alias("_s"), all_.alias("_t"), F.arrays_overlap("ta", "tb").alias("_o"))
    return materialize(told.select("a", "b", (1 - F.col("_s") / (F.col("_t") - F.col("_s"))).alias("apart"), (F.col("_o") & (4 * F.col("_s") >= 3 * (F.col("_t") - F.col("_s")))).alias("alike")), "compared")


def _rarest(nodes: DataFrame) -> DataFrame:
    """(h, weight, own, e) for the rarest ends of each text that make up a quarter of its weight and that other texts have too; own: weight of ends that no other text has."""
    ends = nodes.select("h", "weight", F.explode("parts").alias("e"))
    often = materialize(ends.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "ends")
    w = Window.partitionBy("h")
    shared = ends.join(few(often), "e").withColumn("_w", _end_weight(F.col("e")))
    shared = shared.withColumn("own", F.col("weight") - F.sum("_w").over(w)).withColumn("_before", F.col("own") - F.col("_w") + F.sum("_w").over(w.orderBy("n", "e")))
    return shared.where("4 * _before <= weight").select("h", "weight", "own", "e")


def _groups(lines: DataFrame, held: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(text_hash, root) of texts that are linked as copies. held: texts with the candidate templates they hold."""
    templates = held.groupBy("text_hash").agg(F.sort_array(F.collect_set(F.xxhash64(*_TEMPLATE))).alias("held"))
    texts = lines.join(templates, "text_hash").groupBy("text_hash").agg(F.first(F.struct(F.sort_array("parts").alias("parts"), "held", "weight")).alias("x")).select("text_hash", "x.*")
    # Texts of the same ends and templates are one node.
    texts = materialize(texts.withColumn("shape", F.xxhash64("parts", "held")), "texts")
    nodes = texts.groupBy("shape").agg(F.min("text_hash").alias("h"), F.first(F.struct("parts", "held", "weight")).alias("x"))
    nodes = materialize(nodes.select("shape", "h", "x.*"), "nodes")
    same = texts.select("text_hash", "shape").join(nodes.select("shape", "h"), "shape").where("text_hash <> h").select(F.col("text_hash").alias("a"), F.col("h").alias("b"))
    rare = materialize(_rarest(nodes), "rarest-ends")
    sets = materialize(rare.groupBy("e").agg(F.count("*").alias("m"), F.min(F.struct((F.col("own") / F.col("weight")).alias("share"), "h", "weight")).alias("first")).where("m > 1"), "sets")
    placed = materialize(rare.join(few(sets), "e").select("e", "m", "h", "weight", F.col("first.h").alias("first"), F.col("first.weight").alias("first_weight")), "placed")
    paired, many = placed.where(f"m <= {crowd}"), placed.where(f"m > {crowd}")
    side = lambda df, c, *more: df.select("e", F.col("h").alias(c), F.col("weight").alias(f"w{c}"), *[F.col(x).alias(f"{x}{c}") for x in more])
    pairs = side(paired, "a").join(side(paired, "b"), "e").where("a < b AND " + _sizes_fit("wa", "wb")).select("a", "b")
    to_first = many.where("h <> first").select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b"))
    compared = _compared(pairs.unionByName(to_first).distinct(), nodes)
    links = same.unionByName(compared.where("alike").select("a", "b"))
    roots = components(links).select(F.col("node").alias("h"), "root")
    # Crowded ends whose texts aren't all of one group yet.
    many = many.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = many.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("e")
    apart = compared.select("a", "b", "apart")
    many = many.join(mixed, "e").withColumn("a", F.least("h", "first")).withColumn("b", F.greatest("h", "first")).join(apart, ["a", "b"], "left").withColumn("apart", F.coalesce("apart", F.lit(0.0))).drop("a", "b")
    many = materialize(many, "crowded")
    x, y = side(many, "a", "root", "apart", "first"), side(many, "b", "root", "apart")
    more = x.join(y, "e").where(f"a < b AND roota <> rootb AND firsta <> a AND firsta <> b AND abs(aparta - apartb) <= 0.2500001 AND {_sizes_fit('wa', 'wb')}").select("a", "b").distinct()
    links = links.unionByName(_compared(more.join(compared.select("a", "b"), ["a", "b"], "left_anti"), nodes).where("alike").select("a", "b"))
    return materialize(components(links).select(F.col("node").alias("text_hash"), "root"), "copies")


def cleaned(docs: DataFrame, carry: bool = False, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_recurring and n_dropped of every row (row instead of doc_id if carry).

    n_recurring counts the lines whose template enough rows hold, n_dropped those whose template still recurs once copies
    count once. A null text stays null with 0 lines; an empty one has one line, which is kept. Rows of equal text are one
    document, whatever their ids; null ids count like others. Repeated rows each come back. An empty table gives no rows.
    """
    with scratch() as own:
        lines = materialize(parsed(docs, carry), "lines")
        nodes = _templates(lines, min_docs)
        placed = lines.select("uid", "text_hash", F.posexplode("lines").alias("at", "line")).where("line.node IS NOT NULL").select("uid", "text_hash", "at", "line.node.*")
        # Written first: sizes are then known to the joins, and a template of a third of the lines can be split there.
        found = materialize(placed.join(few(nodes), _NODE).drop("leaf"), "recurring-lines")
        held = found.select("text_hash", *_TEMPLATE).distinct()
        many = materialize(held.groupBy(*_TEMPLATE).agg(F.count("*").alias("n")).where(F.col("n") >= _enough(min_docs)).select(*_TEMPLATE), "candidates")
        held = materialize(held.join(few(many), _TEMPLATE), "held")
        roots = _groups(lines.select("text_hash", "parts", "weight"), held)
        apart = held.join(roots, "text_hash", "left").select(*_TEMPLATE, F.coalesce("root", "text_hash").alias("root")).distinct()
        recurring = materialize(apart.groupBy(*_TEMPLATE).agg(F.count("*").alias("n")).where(F.col("n") >= _enough(min_docs)).select(*_TEMPLATE, F.lit(True).alias("hit")), "recurring")
        own.keep(lines, found, recurring)
    text = F.col("row.text") if carry else F.col("text")
    hits = found.join(few(recurring), _TEMPLATE, "left").groupBy("uid").agg(F.collect_list(F.when(F.col("hit"), F.col("at"))).alias("_hits"), F.count("*").alias("_n"))
    own = ["row"] if carry else ["doc_id"]
    part = lines.select("uid", *own, text.alias("_text"), F.size("lines").alias("_lines")).join(hits, "uid", "left")
    part = part.select(*own, "_text", "_lines", "_hits", "_n", F.array_except(F.sequence(F.lit(0), F.col("_lines") - 1), F.col("_hits")).alias("_keep"))
    return part.select(
        *own,
        F.when(F.size("_hits") > 0, F.expr("transform(array(split(_text, '\\n', -1)), s -> array_join(transform(_keep, i -> s[i]), '\\n'))[0]")).otherwise(F.col("_text")).alias("text"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.col("_lines")).cast("bigint").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_recurring"),
        F.greatest(F.coalesce(F.size("_hits"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of docs without recurring lines, and n_chars (where there is one) to match; columns as given."""
    done = cleaned(docs, carry=True, min_docs=min_docs)
    cut = F.col("n_dropped") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return done.select(*[(F.when(cut, new[c]).otherwise(x) if c in new else x).alias(c) for c, x in own.items()])
