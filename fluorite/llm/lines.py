"""Line dedup by a tree of line templates; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, materialize, maybe_broadcast, read, row_key
from .graph import connected_components

FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Blanks other than a single space.
BLANKS = r"(?:[\t\x0B\f\r]| [ \t\x0B\f\r])[ \t\x0B\f\r]*+"
#: The words after the leading ones are cut into so many parts.
PARTS = [f"f{j}" for j in range(4)]
TEXT = (KEY, "size")


def _masked(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), FIELD, "<*>"), BLANKS, " ")


def _solid(text: Column) -> Column:
    return F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def place_lines(texts: DataFrame, depth: int = 3) -> DataFrame:
    """(key, size, total, at, solid, node, leaf, f0 to f3) for every line with words of texts (key, size, text).

    A word with a digit stands as <*>, and blanks don't count. A node of the
    tree is a number of words and the first ``depth`` of them; a leaf is a
    digest of the whole line. The words after the leading ones are cut into
    four parts and hashed; fewer than four words have no parts.
    """
    masked = texts.select(*TEXT, _masked(F.col("text")).alias("m")).withColumn("total", _solid(F.col("m")))  # once a text, before it is cut
    lines = masked.select(*TEXT, "total", F.posexplode(F.split("m", "\n")).alias("at", "m"))
    lines = lines.withColumn("m", F.trim("m")).where("m <> ''").withColumn("w", F.split("m", " ")).withColumn("r", F.size("w") - depth)
    node = F.xxhash64(F.size("w"), F.substring_index("m", " ", depth)).alias("node")
    leaf = F.conv(F.substring(F.md5(F.col("m").cast("binary")), 1, 15), 16, 10).cast("long").alias("leaf")
    cut = [f"cast({j} * r div 4 as int)" for j in range(5)]
    parts = [F.expr(f"if(r >= 4, hash(slice(w, {depth + 1} + {cut[j]}, {cut[j + 1]} - {cut[j]})), null)").alias(f) for j, f in enumerate(PARTS)]
    return lines.select(*TEXT, "total", "at", _solid(F.col("m")).alias("solid"), node, leaf, *parts)


def generalise(lines: DataFrame) -> DataFrame:
    """(leaf, template): leaves whose line is an instance of another leaf's template, and that leaf.

    Two leaves of a node are linked if no more than one of their four parts
    differs; that part is a variable field. Leaves that agree in the same three
    parts are all linked to the least of them, which joins the same leaves as
    all their pairs would. A template is the least leaf that links reach.
    """
    several = lines.groupBy("node").agg(F.min("leaf").alias("a"), F.max("leaf").alias("b")).where("a <> b").select("node")
    leaves = lines.where("f0 is not null").join(maybe_broadcast(materialize(several)), "node", "left_semi").groupBy("node", "leaf").agg(*[F.first(f).alias(f) for f in PARTS])
    threes = F.array(*[F.struct(*[(F.lit(None).cast("int") if f == left else F.col(f)).alias(f) for f in PARTS]) for left in PARTS])
    keyed = materialize(leaves).select("node", "leaf", F.explode(threes).alias("parts"))
    first = keyed.groupBy("node", "parts").agg(F.min("leaf").alias("least"), F.max("leaf").alias("most")).where("least <> most").select("node", "parts", "least")
    links = keyed.join(maybe_broadcast(materialize(first)), ["node", "parts"]).where("leaf <> least").select(F.col("leaf").alias("a"), F.col("least").alias("b"))
    return materialize(connected_components(links).where("node <> component").select(F.col("node").alias("leaf"), F.col("component").alias("template")))


def recurring_lines(texts: DataFrame, min_docs: int = 3, depth: int = 3) -> DataFrame:
    """(key, size, bad) for texts with lines that recur: their places in the text; see dedup_lines."""
    lines = materialize(place_lines(texts, depth))
    merged = generalise(lines)
    lines = lines.drop(*PARTS).join(maybe_broadcast(merged), "leaf", "left").withColumn("leaf", F.coalesce("template", "leaf")).drop("template")
    several = lines.groupBy("node", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("node", "leaf")
    # few lines are left; rows with the same text have each of theirs once from here on
    lines = materialize(lines.join(maybe_broadcast(materialize(several)), ["node", "leaf"], "left_semi").dropDuplicates([*TEXT, "at"]))
    by_text = materialize(lines.groupBy("node", "leaf", *TEXT).agg(F.sum("solid").alias("solid"), F.first("total").alias("total")))

    def had_by(rows: DataFrame) -> DataFrame:
        return maybe_broadcast(materialize(rows.groupBy("node", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("node", "leaf")))

    shared = by_text.join(had_by(by_text), ["node", "leaf"], "left_semi")
    copies = shared.groupBy(*TEXT).agg(F.sum("solid").alias("covered"), F.first("total").alias("total")).where("covered * 10 >= total * 9").select(*TEXT)
    recur = had_by(shared.join(copies, list(TEXT), "left_anti"))
    bad = lines.join(recur, ["node", "leaf"], "left_semi").groupBy(*TEXT).agg(F.sum("solid").alias("covered"), F.first("total").alias("total"), F.collect_list("at").alias("bad"))
    return materialize(bad.where("covered < total").select(*TEXT, "bad"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, depth: int = 3, text_col: str = "text") -> DataFrame:
    """Drops lines whose template recurs across documents.

    Every line goes to a leaf of a tree of fixed depth: its number of words,
    then its first ``depth`` words, then the templates of that node. Words with
    a digit are variable, and so are the parts in which a line differs from
    others of its node (see generalise). A template that at least
    ``min_docs`` different texts have is a candidate. A text nine tenths of which
    (by signs that aren't blank) are candidates is taken to be a copy of other
    texts and not a document around a passage: it has no say. A
    candidate that at least ``min_docs`` of the others have recurs: wherever it
    stands, in blocks of several lines too, and however many copies have it. All
    lines of recurring templates are dropped from all texts, but a text that
    has nothing else stays whole. Copies of a document, however many, keep the
    lines that only they share; they are the near-duplicate operators' work.

    Returns the columns of docs in their order, text without the dropped lines,
    then n_lines and n_dropped (long). Null text stays null with 0 lines; empty
    text has one line, and lines without words are never dropped. Rows repeated
    with the same text count as one text. Texts of very many lines cost time in
    proportion to them. Empty input: no rows. Columns of docs named n_lines or
    n_dropped are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.col(text_col)
    bad = recurring_lines(docs.select(row_key(text).alias(KEY), F.coalesce(F.length(text), F.lit(0)).alias("size"), text.alias("text")), min_docs, depth)
    rows = docs.select(F.struct(*names).alias("row"), row_key(text).alias("__key"), F.coalesce(F.length(text), F.lit(0)).alias("__size"))
    bad = bad.select(F.col(KEY).alias("__key"), F.col("size").alias("__size"), "bad")
    joined = rows.join(bad.hint("shuffle_hash"), ["__key", "__size"], "left").select("row", F.col("row").getField(text_col).alias("__text"), "bad")
    joined = joined.withColumn("__lines", F.when(F.col("bad").isNotNull(), F.split("__text", "\n")))  # a column of its own: cut once, not for each line
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "bad"), lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumn("__kept", F.when(F.col("bad").isNotNull(), kept).otherwise(F.col("__text")))
    n_lines = F.coalesce(F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_dropped = F.when(F.col("bad").isNotNull(), F.size("bad")).otherwise(0).cast("long")
    return joined.select(*[(F.col("__kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in names], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t FROM documents),
x AS (SELECT t, string_split(t, chr(10)) AS lines FROM (SELECT DISTINCT t FROM d)),
l AS (SELECT t, i, lines[i] AS line, trim(regexp_replace(array_to_string(list_transform(regexp_split_to_array(lines[i], '[ \t\x0B\f\r]+'),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' '), '[ ]+', ' ', 'g')) AS m
      FROM (SELECT t, lines, unnest(range(1, len(lines) + 1)) AS i FROM x)),
p AS (SELECT t, i, m, length(replace(m, ' ', '')) AS solid, string_split(m, ' ') AS w FROM l WHERE m <> ''),
q AS (SELECT *, len(w) || ' ' || array_to_string(w[1:3], ' ') AS node, len(w) - 3 AS r FROM p),
leaves AS (
  SELECT node, m, substr(md5(m), 1, 15) AS id, sum(c) AS n, any_value(list_transform(range(0, 4), lambda j: array_to_string(w[4 + j * r // 4:3 + (j + 1) * r // 4], ' '))) AS parts
  FROM q JOIN (SELECT t, count(*) AS c FROM d GROUP BY t) USING (t) WHERE r >= 4 GROUP BY node, m),
keyed AS (SELECT *, parts[j] AS part FROM (SELECT *, unnest([1, 2]) AS j FROM leaves)),
firsts AS (SELECT node, j, part, max(struct_pack(n := n, id := id)) AS of FROM keyed GROUP BY node, j, part HAVING count(*) > 1),
met AS (SELECT DISTINCT k.node, k.id, k.parts, x.of.id AS other FROM keyed k JOIN firsts x USING (node, j, part) WHERE struct_pack(n := k.n, id := k.id) < x.of),
led AS (
  SELECT met.node, met.id, max(struct_pack(n := o.n, id := o.id)).id AS template
  FROM met JOIN leaves o ON o.node = met.node AND o.id = met.other
  WHERE len(list_filter(range(1, 5), lambda j: met.parts[j] <> o.parts[j])) <= 1 GROUP BY met.node, met.id),
hop1 AS (SELECT a.node, a.id, coalesce(b.template, a.template) AS template FROM led a LEFT JOIN led b ON a.node = b.node AND a.template = b.id),
hop2 AS (SELECT a.node, a.id, coalesce(b.template, a.template) AS template FROM hop1 a LEFT JOIN led b ON a.node = b.node AND a.template = b.id),
hop3 AS (SELECT a.node, a.id, coalesce(b.template, a.template) AS template FROM hop2 a LEFT JOIN led b ON a.node = b.node AND a.template = b.id),
placed AS (SELECT q.t, q.i, q.solid, q.node, coalesce(h.template, substr(md5(q.m), 1, 15)) AS leaf FROM q LEFT JOIN hop3 h ON q.node = h.node AND substr(md5(q.m), 1, 15) = h.id),
by_text AS (SELECT node, leaf, t, sum(solid) AS solid FROM placed GROUP BY node, leaf, t),
cand AS (SELECT node, leaf FROM by_text GROUP BY node, leaf HAVING count(*) >= 3),
total AS (SELECT t, sum(solid) AS total FROM q GROUP BY t),
copies AS (SELECT t FROM by_text JOIN cand USING (node, leaf) JOIN total USING (t) GROUP BY t HAVING 10 * sum(solid) >= 9 * any_value(total)),
recur AS (SELECT node, leaf FROM by_text JOIN cand USING (node, leaf) WHERE t NOT IN (SELECT t FROM copies) GROUP BY node, leaf HAVING count(*) >= 3),
bad AS (SELECT t, list(i) AS bad FROM placed JOIN recur USING (node, leaf) JOIN total USING (t) GROUP BY t HAVING sum(solid) < any_value(total)),
k AS (SELECT l.t, string_agg(line, chr(10) ORDER BY i) AS kept FROM l JOIN bad ON l.t = bad.t WHERE NOT list_contains(bad, i) GROUP BY l.t),
o AS (SELECT r, doc_id, text, t, coalesce(kept, t) AS kept, coalesce(len(bad), 0) AS n_dropped FROM d LEFT JOIN bad USING (t) LEFT JOIN k USING (t))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(string_split(t, chr(10))) AS BIGINT) END AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       CAST(length(kept) AS BIGINT) AS n_chars_kept, sha256(kept) AS kept_sha256
FROM o
""",
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
