"""Personal data: base patterns, and bootstrapped contextual extraction; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, materialize, maybe_broadcast, read, row_key

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive quantifiers where giving back can't lead to a match, and
# tried at the start of a run only: the same matches, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may be an identifier: a word with a digit or an at sign, or digits and signs after a plus.
CANDIDATE = r"(?<!\S)(?:\+[0-9][ ().0-9-]*[0-9]|[^\s0-9@]*+[0-9@]\S*+)"
#: Signs around a candidate or a context word that are not part of it.
AROUND = ".,;:!?\"'()[]{}<>#%&*$="


def is_valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern is one of its kind."""
    parts = F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    digits = F.regexp_replace(value, "[ -]", "")
    turned = F.reverse(digits)

    def luhn(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    card = F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), luhn) % 10 == 0).otherwise(False)
    phone = F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.when(kind == "ip", parts).when(kind == "card", card).when(kind == "phone", phone).otherwise(F.lit(True))


def _matches(text: Column, pattern: str, kind: str, within: Column | None = None) -> Column:
    """array<struct<kind, at, gap, value, left, right>>: matches in order, with the text between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    flat = lambda c: F.translate(c, "\n\t\r\x0b\x0c", "     ")

    # most words lie within 64 characters; where no blank shows that one ends there, all of the gap is read
    def before(i: Column) -> Column:
        gap = F.get(between, i)
        near = F.rtrim(flat(F.right(gap, F.lit(64))))
        return F.substring_index(F.when((F.length(gap) <= 64) | F.contains(near, F.lit(" ")), near).otherwise(F.rtrim(flat(gap))), " ", -1)

    def after(i: Column) -> Column:
        gap = F.get(between, i + 1)
        near = F.ltrim(flat(F.left(gap, F.lit(64))))
        return F.substring_index(F.when((F.length(gap) <= 64) | F.contains(near, F.lit(" ")), near).otherwise(F.ltrim(flat(gap))), " ", 1)

    context = kind == "candidate"
    none = F.lit(None).cast("string")

    def one(v: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(F.get(between, i)).alias("gap"), v.alias("value"),
            (before(i) if context else none).alias("left"), (after(i) if context else none).alias("right"),
        )

    out = F.transform(found, one)
    return out if within is None else F.when(within, out).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:int,value:string,left:string,right:string>>"))


def find_personal(
    docs: DataFrame,
    rounds: int = 3,
    least_seeds: int = 3,
    least_confidence: float = 0.7,
    least_score: float = 0.9,
    least_patterns: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of personal data in whole texts.

    Base: matches of the four base patterns, leftmost and not overlapping for
    each kind, that are valid for their kind. Bootstrapping: valid candidate
    words are seeds; a pattern is the word before or after a candidate with the
    candidate's shape (letters and digits generalised); patterns and candidate
    values make a graph over the whole corpus. For ``rounds`` rounds a pattern's
    confidence for a kind is the scores of its values over their number plus
    one, and a value's score is the chance that one of its confident patterns is
    right. Values that reach ``least_score`` by ``least_patterns`` patterns, each
    with ``least_seeds`` seeds or more, are identifiers wherever they stand.

    Returns id, __row_key (a hash of the text), and base and found: arrays of
    struct (kind, start, end, value), by kind, then start; start counts code
    points, end is exclusive. A row for each row of docs; null and empty texts
    have empty arrays; repeated rows get the same spans each; long texts are
    read whole, context words of any length too; empty input: no rows. Other
    columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = [_matches(text, PATTERNS[k], k, needs.get(k)) for k in KINDS] + [_matches(text, CANDIDATE, "candidate")]
    rows = materialize(docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias(KEY), F.concat(*parts).alias("m")))
    each = rows.where(F.size("m") > 0).select("id", KEY, F.explode("m").alias("m")).select("id", KEY, "m.*").dropDuplicates(["id", KEY, "kind", "at"])
    order = W.partitionBy("id", KEY, "kind").orderBy("at")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    start = (F.sum("gap").over(upto) + F.coalesce(F.sum(F.length("value")).over(before), F.lit(0))).cast("long")
    placed = materialize(each.withColumn("start", start).withColumn("end", F.col("start") + F.length("value")).where((F.col("kind") != "card") | (F.length("value") >= 13)))
    base = placed.where((F.col("kind") != "candidate") & is_valid(F.col("kind"), F.col("value")))

    # candidates without the signs around them, their shape, and the kind that they are sure to be of;
    # no shape of a seed has fewer than five signs, so shorter candidates can't be reached
    inner = F.col("inner")
    led = F.length("value") - F.length(F.ltrim(F.col("value"), F.lit(AROUND)))
    some = placed.where("kind = 'candidate'").withColumn("inner", F.trim(F.col("value"), F.lit(AROUND))).where(F.length("inner") >= 5)
    some = some.withColumn("start", F.col("start") + led).withColumn("end", F.col("start") + F.length("inner"))
    kind = F.coalesce(*[F.when(inner.rlike(f"^(?:{PATTERNS[k]})$") & is_valid(F.lit(k), inner), F.lit(k)) for k in KINDS])
    shape = F.md5(F.regexp_replace(F.regexp_replace(inner, "[A-Za-z]+", "a"), "[0-9]", "9").cast("binary"))
    some = some.select("id", KEY, "start", "end", F.col("inner").alias("value"), F.md5(inner.cast("binary")).alias("v"), shape.alias("shape"), kind.alias("seed"), F.lower(F.trim(F.col("left"), F.lit(AROUND))).alias("left"), F.lower(F.trim(F.col("right"), F.lit(AROUND))).alias("right"))
    some = materialize(some)
    sides = [some.where(F.length(side) > 0).select(F.concat_ws("|", F.lit(side), F.col(side), "shape").alias("p"), "v", "seed") for side in ("left", "right")]
    every = reduce(DataFrame.union, sides)
    # only patterns with enough seeds can ever be confident; both sums are combined before they are dealt out
    sown = every.where("seed is not null").groupBy("p", "seed", "v").agg(F.lit(1).alias("one")).groupBy("p", "seed").agg(F.count("one").alias("n")).where(F.col("n") >= least_seeds).select("p").distinct()
    edges = materialize(every.join(maybe_broadcast(materialize(sown)), "p", "left_semi").groupBy("p", "v").agg(F.max("seed").alias("seed")))
    seeds = edges.where("seed is not null").select("v", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("sure")).distinct()
    degree = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    unsure = edges.where("seed is null").select("p", "v")
    scores, reached = seeds, None
    for _ in range(rounds):
        by_pattern = edges.select("p", "v").join(scores, "v").groupBy("p", "kind").agg(F.sum("score").alias("s"), F.sum("sure").alias("seeds"))
        confident = by_pattern.where(F.col("seeds") >= least_seeds).join(degree, "p").withColumn("c", F.col("s") / (F.col("n") + 1)).where(F.col("c") >= least_confidence)
        confident = materialize(confident.select("p", "kind", "c"))
        reached = unsure.join(maybe_broadcast(confident), "p").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("score"), F.count(F.lit(1)).alias("patterns"))
        reached = materialize(reached)
        scores = seeds.union(reached.select("v", "kind", "score", F.lit(0).alias("sure")))
    good = reached.where((F.col("score") >= least_score) & (F.col("patterns") >= least_patterns)) if reached is not None else None
    spans = base.select("id", KEY, F.lit(0).alias("new"), "kind", "start", "end", "value")
    if good is not None:
        best = good.groupBy("v").agg(F.max(F.struct("score", "kind")).alias("b")).select("v", F.col("b.kind").alias("kind"))
        spans = spans.union(some.where("seed is null").join(maybe_broadcast(materialize(best)), "v").select("id", KEY, F.lit(1).alias("new"), "kind", "start", "end", "value"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    by_row = spans.groupBy("id", KEY).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "value", "new"))).alias("spans"))
    joined = rows.select("id", KEY).alias("d").join(by_row.alias("s"), F.expr(f"d.id <=> s.id and d.{KEY} = s.{KEY}"), "left")
    slim = lambda new: F.transform(F.filter("spans", lambda x: x["new"] == new), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return joined.select(F.col("d.id").alias(id_col), F.col(f"d.{KEY}"), F.coalesce(slim(0), none).alias("base"), F.coalesce(slim(1), none).alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as in KINDS, then start."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"),
    )


QUERIES = {"op3_personal_data": op3_personal_data}
SQL: dict[str, str] = {}
