"""N-gram Jaccard join: prefix filters under several global orders, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, materialize, maybe_broadcast, pieces, read, release, row_key, ship, small
from .graph import connected_components

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker remembers at a time.
_REMEMBER = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of k-word shingles, as sorted 64-bit hashes."""

    def __init__(self, k: int, seed: int = 0) -> None:
        self.k, self.seed, self.words = k, seed, {}
        with np.errstate(over="ignore"):
            self.by_place = _mix((np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * _GOLD) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z, and at \x20 and \x09-\x0D
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), self.seed + 1)], np.uint64)
        known = self.words
        if len(known) > _REMEMBER:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w, self.seed)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        total = h[:n] * self.by_place[0]
        for i in range(1, self.k):
            total += h[i : i + n] * self.by_place[i]
        return np.unique(_mix(total))


def prefix_size(n: int, num: int, den: int) -> int:
    """How many first items a set of n may not all miss and still reach num / den."""
    return n - -(-n * num // den) + 1


def _bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each token: 4 to 8 bits a token, a power of two. Shorter ones are folds of longer ones."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.intp)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.large_binary()).to_pylist()


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)))


def jaccard_components(
    docs: DataFrame,
    k: int = 3,
    num: int = 90,
    den: int = 100,
    orders: int = 3,
    often: int = 16,
    most_often: int = 1 << 20,
    bucket_bytes: int = 32 << 20,
    most_places: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_key: bool = False,
) -> DataFrame:
    """Groups of documents whose sets of k-word shingles have a Jaccard similarity of num / den or more.

    1. Documents with the same set are one class, so copies cost no pairs.
    2. Tokens (shingles) of all documents are counted, in buckets whose number
       follows the size of all texts (``bucket_bytes`` of text a bucket). Global
       orders put the most frequent tokens last: those of ``often`` documents or
       more, or the most frequent ``most_often`` or so of them (their table is
       broadcast). Tokens of one document come first, then those of fewer than
       ``often``, then the other ones of ``often`` or more, and within these by a
       hash. What comes when is read from two maps with a bit for each of up to
       2**``most_places`` places (64 and 8 MB at most, broadcast): a place has the mark if any of its tokens has,
       which may put a token later than its count would, but in all sets alike.
       To link, two sets must share one of their first
       n - ceil(n * num / den) + 1 tokens under every order; any order gives the
       same links. Tokens of one document link nothing and are not passed on, so
       texts with enough of them make no pairs.
    3. Classes that share a rare token of the first order are paired. A token
       with the mark of ``often`` documents, but too few to be last, is crowded:
       its classes pair only with its hub at first, the class with the fewest
       rare tokens; links make components. Then classes in other components than their hub's are paired
       with those that share a token of the second order too.
    4. Two sets without a common rare token share at most their frequent tokens,
       and so must have few rare ones. Each class is tried against a hub of each
       of its frequent tokens as well. Then classes in other components than
       their hub's are paired with what else of that token the counts of rare
       tokens allow. So a large group of near copies doesn't give all its pairs,
       and pairs of a token don't grow with the square of its documents.
    5. Bitmaps of the sets bound what a pair shares. Pairs that may still link
       go through the filters under the other orders; the rest are verified on
       whole sets. Components are made from all links.

    Returns id, n_shingles (long) and component_id, the least id reachable, for
    each row of docs. Null, empty and blank texts have no shingles and are alone;
    fewer than k words are one shingle. Rows repeated with the same text share a
    group. A null id is alone unless its text links to others, and never names
    a group. Empty input: no rows. Other columns of docs are ignored. With
    ``with_key`` the hash of the text follows, and is_first: whether the row is
    the one of its group that stays, the first by id, then hash.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(text_col)).alias("key"))
    steps = np.arange(orders, dtype=np.uint64) * _GOLD
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(12, (total // bucket_bytes).bit_length()))
    places = max(bits + 6, min(most_places, (total // 8).bit_length()))
    maps = {"twice": (2, places), "many": (often, places - 3)}  # the marks of at least so many documents, and places as a power of two

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The upper bits of all tokens, dealt by the first few, as packed numbers of the 32 that follow."""
        shingle = Shingler(k, seed)

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            token = np.sort(np.concatenate(parts))
            bucket = (token >> np.uint64(64 - bits)).astype(np.int32)
            rest = (token >> np.uint64(32 - bits)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            groups = np.split(rest, cuts)
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts]).astype(int)]), pa.array([g.tobytes() for g in groups], pa.binary())], ["bucket", "rest"])

        parts, held = [], 0
        for batch in pieces(batches):
            for text in _texts(batch, 0):
                s = shingle(text)
                if len(s):
                    parts.append(s)
                    held += len(s)
                if held > 1 << 20:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    def frequent(pdf: pd.DataFrame) -> pd.DataFrame:
        token, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["rest"]]), return_counts=True)
        some = n >= often
        bucket = int(pdf["bucket"].iloc[0])
        upper = (np.uint64(bucket) << np.uint64(32)) | token[some].astype(np.uint64)
        parts = {}
        for kind, (least, size) in maps.items():
            marks = np.zeros(1 << size - bits, bool)
            marks[token[n >= least] >> np.uint32(32 - size + bits)] = True
            parts[kind] = [None] * len(upper) + [np.packbits(marks, bitorder="little").tobytes()]
        return pd.DataFrame({"token": np.append(upper.astype(np.int64), bucket), "n": np.append(n[some], 0)} | parts)

    def marked(s: np.ndarray, places_of: np.ndarray) -> np.ndarray:
        """Whether a map has the place of each token; without a map none."""
        if not len(places_of):
            return np.zeros(len(s), bool)
        at = s >> np.uint64(65 - (8 * len(places_of)).bit_length())
        return places_of[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

    def levels(s: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """0: in no other document; 1: in few at most; 2: may be crowded; 3: among the most frequent."""
        last, twice, many = known
        level = marked(s, twice).astype(np.int8)
        level += level * marked(s, many)
        level[is_frequent(s, last)] = 3
        return level

    def is_frequent(s: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(last) or not len(s):
            return np.zeros(len(s), bool)
        upper = s >> np.uint64(32 - bits)
        return last[np.minimum(np.searchsorted(last, upper), len(last) - 1)] == upper

    def in_order(s: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
        """Places of the prefix of set s under an order."""
        p = prefix_size(len(s), num, den)
        return np.lexsort((s if order == 0 else _mix(s + steps[order]), level))[:p]

    def digest(s: np.ndarray) -> tuple[int, int]:
        d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
        return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(k, seed), hot.value
        for batch in pieces(batches):
            sets = [shingle(t) for t in _texts(batch, 1)]
            digests = [digest(s) if len(s) else (None, None) for s in sets]
            marks = [levels(s, known) for s in sets]
            first = [in_order(s, m, 0) if len(s) else np.empty(0, int) for s, m in zip(sets, marks, strict=True)]
            second = [in_order(s, m, 1) if (m[f] == 2).any() else f[:0] for s, m, f in zip(sets, marks, first, strict=True)]
            listed = [[s[f[m[f] == level]] for s, m, f in zip(sets, marks, first, strict=True)] for level in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int((m < 3).sum()) for m in marks], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    *map(_lists, listed),
                    _lists([s[f[m[f] > 0]] if len(f) else s[:0] for s, m, f in zip(sets, marks, second, strict=True)]),
                    _lists([_bitmap(s) if len(s) else s for s in sets]),
                ],
                ["id", "key", "n", "r", "cls", "more", "rare", "crowd", "often", "second", "bits"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(k, seed), hot.value
        for batch in pieces(batches):
            sets = [s for s in map(shingle, _texts(batch, 1)) if len(s)]
            for at in range(0, len(sets), 256):
                some = sets[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s)[0] for s in some], pa.int64()), _lists(some), *[_lists([s[in_order(s, levels(s, known), o)] for s in some]) for o in range(1, orders)]],
                    ["cls", "tokens", *[f"p{o}" for o in range(1, orders)]],
                )

    def whole_map(kind: str) -> np.ndarray:
        """The buckets' parts side by side, as many bits whatever the number of tokens."""
        size = maps[kind][1]
        out, width = np.zeros(1 << size - 3, np.uint8), 1 << size - bits - 3
        for bucket, part in counts.where(F.col(kind).isNotNull()).select("token", kind).coalesce(8).toLocalIterator():
            out[bucket * width : (bucket + 1) * width] = np.frombuffer(part, np.uint8)
        return out

    for seed in range(3):
        counts = materialize(texts.select("text").mapInArrow(count_tokens, "bucket int, rest binary").groupBy("bucket").applyInPandas(frequent, "token long, n long, twice binary, many binary"))
        release(spark)
        least = often
        while not small(counts.where(F.col("n") >= least), most_often):
            least *= 2
        crowded = not counts.where((F.col("n") >= often) & (F.col("n") < least)).isEmpty()
        found = counts.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64)  # most_often at most
        hot = spark.sparkContext.broadcast((np.sort(found.astype(np.uint64)), whole_map("twice"), whole_map("many") if crowded else np.empty(0, np.uint8)))
        schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("key", "n", "r", "cls", "more")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("rare", "crowd", "often", "second", "bits")])
        rows = materialize(texts.mapInArrow(prefixes, schema))
        classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.first("bits").alias("bits"), F.first("often").alias("often"), F.first("second").alias("second"), F.min("more").alias("m0"), F.max("more").alias("m1"))
        classes = materialize(classes)
        if classes.where("m0 <> m1").isEmpty():
            break
    else:
        raise RuntimeError("hashes of different sets keep colliding")

    def alike(a: str, b: str, most: str | None = None) -> str:
        """SQL: whether sizes allow a link, given the most that two sets can share."""
        most = most or f"least({a}.n, {b}.n)"
        return f"({most}) * {den} >= ({a}.n + {b}.n - ({most})) * {num}"

    def postings(kind: str) -> DataFrame:
        return rows.where("cls is not null").select("cls", "n", "r", F.explode(kind).alias("token"))

    def hubs_of(kind: DataFrame, least: int) -> DataFrame:
        found = kind.groupBy("token").agg(F.min(F.struct("r", "n", "cls")).alias("hub"), F.count(F.lit(1)).alias("size")).where(F.col("size") > least)
        return materialize(found.select("token", "hub.*"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) that pass all filters and are similar enough."""
        pairs = materialize(pairs.distinct())
        bits = classes.select("cls", "bits")
        both = pairs.join(bits.toDF("a", "xa"), "a").join(bits.toDF("b", "xb"), "b")
        for x, y in (("xa", "xb"), ("xb", "xa")):
            twice = f"zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p | q)"
            more = f"transform(sequence(1, size({y})), i -> aggregate(sequence(i, size({x}), size({y})), 0L, (s, j) -> s | element_at({x}, j)))"
            both = both.withColumn(x, F.expr(f"case when size({x}) > 2 * size({y}) then {more} when size({x}) > size({y}) then {twice} else {x} end"))
        only = "aggregate(zip_with({0}, {1}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)"
        both = both.withColumn("most", F.expr(f"least(na - {only.format('xa', 'xb')}, nb - {only.format('xb', 'xa')})"))
        pairs = materialize(both.where(f"most * {den} >= (na + nb - most) * {num}").select("a", "b", "na", "nb"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select(F.col("first.id").alias("wanted"), F.col("first.key").alias("wanted_key"))
        wanted = materialize(wanted)
        some = texts.join(maybe_broadcast(wanted.distinct()), F.expr("id <=> wanted and key = wanted_key"), "left_semi")
        sets = some.mapInArrow(whole, "cls long, tokens array<long>, " + ", ".join(f"p{o} array<long>" for o in range(1, orders)))
        sets = materialize(sets.dropDuplicates(["cls"]))
        for o in range(1, orders):
            a, b = (sets.select(F.col("cls").alias(x), F.col(f"p{o}").alias(f"p{x}")) for x in "ab")
            pairs = pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("pa", "pb")).drop("pa", "pb")
        pairs = materialize(pairs)
        a, b = (sets.select(F.col("cls").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        common = F.size(F.array_intersect("ta", "tb")).cast("long")
        checked = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", common.alias("c"))
        return materialize(checked.where(F.col("c") * den >= (F.col("na") + F.col("nb") - F.col("c")) * num).select("a", "b"))

    named_pair = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.expr("if(x.cls < y.cls, x.n, y.n)").alias("na"), F.expr("if(x.cls < y.cls, y.n, x.n)").alias("nb")]
    without_rare = "least(x.n - x.r, y.n - y.r)"
    rare, shared = postings("rare"), materialize(postings("often").dropDuplicates(["token", "cls"]))
    hubs = hubs_of(shared, 1)
    if crowded:  # there are none as long as all tokens of ``often`` documents are last
        crowd = materialize(postings("crowd").dropDuplicates(["token", "cls"]))
        crowds = hubs_of(crowd, 1)
    thin = rare.repartition("token").dropDuplicates(["token", "cls"])  # fewer than ``often`` documents a token
    met = thin.alias("x").join(thin.alias("y"), F.expr("x.token = y.token and x.cls < y.cls and " + alike("x", "y"))).select(*named_pair)

    def stars(kind: DataFrame, centres: DataFrame, most: str | None = None) -> DataFrame:
        return kind.alias("x").join(maybe_broadcast(centres).alias("y"), F.expr("x.token = y.token and x.cls <> y.cls and " + alike("x", "y", most))).select(*named_pair)

    met = met.union(stars(shared, hubs, without_rare))
    links = linked(met.union(stars(crowd, crowds)) if crowded else met)
    release(spark)
    group = materialize(connected_components(links))

    def grouped(df: DataFrame) -> DataFrame:
        found = df.join(group.select(F.col("node").alias("cls"), "component"), "cls", "left")
        return found.withColumn("component", F.coalesce("component", "cls"))

    def apart_and_all(kind: DataFrame, centres: DataFrame, also: str) -> tuple[DataFrame, DataFrame]:
        """Classes in another component than their hub's, and all classes of those tokens; with the tokens ``also``."""
        placed = materialize(grouped(kind).join(maybe_broadcast(grouped(centres).select("token", F.col("component").alias("main"))), "token"))
        some = materialize(placed.where("component <> main"))
        tokens = some.select("token").distinct()
        more = classes.select("cls", F.col(also).alias("also"))
        return some.join(more, "cls"), placed.join(maybe_broadcast(materialize(tokens)), "token", "left_semi").join(more, "cls")

    apart, every = apart_and_all(shared, hubs, "often")
    once = "x.token = array_min(array_intersect(x.also, y.also))"  # a pair comes from its first common token only
    rest = apart.alias("x").join(every.alias("y"), F.expr(f"x.token = y.token and x.component <> y.component and {alike('x', 'y', without_rare)} and {once}")).select(*named_pair)
    if crowded:
        apart, every = (df.withColumn("also", F.explode("also")) for df in apart_and_all(crowd, crowds, "second"))
        rest = rest.union(apart.alias("x").join(every.alias("y"), F.expr(f"x.token = y.token and x.also = y.also and x.component <> y.component and {alike('x', 'y')}")).select(*named_pair))
    more = linked(rest)
    release(spark)
    if not more.isEmpty():
        group = materialize(connected_components(links.union(more)))
    named = classes.select("cls", F.col("first").alias("own")).join(group.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("own").alias("first"))
    named = materialize(named.join(first, "component").select("cls", "first"))
    out = rows.select("id", "key", "n", "cls").join(named, "cls", "left")
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id")]
    if with_key:
        cols += [F.col("key").alias(KEY), F.coalesce(F.expr("id <=> first.id and key = first.key"), F.lit(True)).alias("is_first")]
    return out.select(*cols)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL: dict[str, str] = {}
