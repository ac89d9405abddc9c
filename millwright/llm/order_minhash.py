"""Near-duplicate classes by Order MinHash, verified by banded alignment of words.

Every distinct text gets TABLES keys. A key draws the two least of the text's occurrence-labelled k-mers of words and
keeps them in text order, so texts agree in a key more often the closer they are in edit distance. Members of a bucket
are aligned with its leader, and those that are not near it with a next one. A bucket whose members are then joined is
settled; in every other one, each pair of members that no chain of links joins is a candidate, those near a leader too.
Lengths in bands and coarse and fine bags of words, compared in blocks inside tasks, drop candidates that cannot be near;
only the rest become rows and are aligned. No step loses a near pair of a bucket, so the classes, the components of
the verified links, are those of comparing all pairs of every bucket at any input size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import slices, staged, text_buffer

K = 5
TABLES = 16
SIMILARITY = 0.8
LEADERS = 2
"""Leaders that the members of a bucket meet before the pairs of an unsettled one are enumerated."""
BAG = 128
FINE_BAG = 4096
BAG_ROWS = 256
BLOCK = 512
"""Members of a bucket that a task compares with as many others."""
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words before each row, place of each word) for words between ASCII white space."""
    ink = ~SPACES[buf]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    rows = offsets[:-1][offsets[:-1] < len(buf)]
    head[rows] = ink[rows]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return rolling.hashes(rolling.prefix(buf), start, end), np.searchsorted(start, offsets), start


def labelled_kmers(word: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, k-mers before each row): k-mers of words with their occurrence number; a shorter text is one k-mer."""
    n = np.diff(begin)
    p = rolling.prefix(word)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    start = begin[row] + np.arange(len(row)) - before[row]
    h = rolling.hashes(p, start, np.minimum(start + k, begin[row + 1]))
    label = rolling.occurrences(h, row)
    return rolling.mix(h + label * np.uint64(0xD6E8FEB86659FD93)), before


def sketch(kmer: np.ndarray, before: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first k-mers, second k-mers), each tables x rows; rows without k-mers get 0."""
    full = np.flatnonzero(np.diff(before))
    out = np.zeros((3, tables, len(before) - 1), np.uint64)
    if not len(full):
        return tuple(out)
    starts = before[:-1][full]
    low = np.uint64((1 << max(len(kmer).bit_length(), 1)) - 1)
    place = np.arange(len(kmer), dtype=np.uint64)
    for t in range(tables):
        value = (rolling.mix(kmer, t + 11) & ~low) | place
        one = (np.minimum.reduceat(value, starts) & low).astype(np.int64)
        value[one] = ~np.uint64(0)
        two = (np.minimum.reduceat(value, starts) & low).astype(np.int64)
        two = np.where(np.diff(before)[full] > 1, two, one)
        first, second = kmer[np.minimum(one, two)], kmer[np.maximum(one, two)]
        out[:, t, full] = rolling.mix(rolling.mix(first, 3) + second * np.uint64(0xA24BAED4963EE407), t + 101), first, second
    return tuple(out)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(count)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def sketches(docs: DataFrame, k: int = K, tables: int = TABLES) -> DataFrame:
    """(doc, content, n_words, keys) of docs (doc, content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            word, begin, _ = words(*text_buffer(part.column(2)))
            n = np.diff(begin)
            keys = sketch(*labelled_kmers(word, begin, k), tables)[0].T[n > 0].ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), _lists(keys, np.where(n > 0, tables, 0))], ["doc", "content", "n_words", "keys"]
            )

    return docs.select("doc", "content", "text").mapInArrow(run, "doc bigint, content binary, n_words bigint, keys array<bigint>")


def _most(n: np.ndarray, similarity: float) -> np.ndarray:
    """Word edits that texts may differ by whose longer one has n words."""
    return ((1 - similarity) * n + 1e-9).astype(np.int64)


def bags(docs: DataFrame) -> DataFrame:
    """(doc, bag) of docs (doc, text): words in each of BAG classes of hashes, then in each of FINE_BAG, at most 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x.slice(at, BAG_ROWS) for x in slices(batches, "text") for at in range(0, x.num_rows, BAG_ROWS)):
            word, begin, _ = words(*text_buffer(part.column("text")))
            n = np.diff(begin)
            row = np.repeat(np.arange(len(n)), n)
            both = np.zeros((len(n), BAG + FINE_BAG), np.uint8)
            for first, size in ((0, BAG), (BAG, FINE_BAG)):
                count = np.bincount(row * size + (rolling.mix(word, size) % np.uint64(size)).astype(np.int64), minlength=len(n) * size)
                both[:, first : first + size] = np.minimum(count, 255).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([x.tobytes() for x in both], pa.binary())], ["doc", "bag"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, bag binary")


def _apart(bags: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The larger of what either bag has over the other, for each row of `bags` against `one`."""
    off = bags.astype(np.int16) - one
    return np.maximum(np.maximum(off, 0).sum(axis=1), np.maximum(-off, 0).sum(axis=1))


def distance_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`: a bit-parallel alignment of the diagonal band of that
    half width, the band tried from narrow to wide."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if len(a) <= most:
        return True
    count = Counter(a)
    count.subtract(b)
    if sum(x for x in count.values() if x > 0) > most:
        return False
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    band = max(8, len(a) - len(b))
    while band < most:
        if _banded(a, b, places, band):
            return True
        band *= 2
    return _banded(a, b, places, most)


def _banded(a: list, b: list, places: dict, k: int) -> bool:
    """Edit distance at most k; len(a) >= len(b) and len(a) > k. Bit i of a vector is row (column - k + i) of the matrix."""
    if len(a) <= k:
        return True
    width = 2 * k + 1
    full = (1 << width) - 1
    up, down, score = full ^ ((1 << k) - 1), 0, k
    diagonal, bottom = 1 << (width - 1), 1 << width >> 2
    limit = k + len(b) - (len(a) - k)
    for j, x in enumerate(b):
        at = j - k
        match = places.get(x, 0)
        match = (match >> at if at > 0 else match << -at) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full & ~(same | up))
        left = same & up
        if j < len(a) - k:
            if not same & diagonal:
                score += 1
                if score > limit:
                    return False
        else:
            if right & bottom:
                score += 1
            elif left & bottom:
                score -= 1
            bottom >>= 1
        shifted = same >> 1
        up = (left | (full & ~(shifted | right))) & full
        down = shifted & right
    return score <= k


def near(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Word edit distance at most (1 - similarity) of the longer text; a text without words is near to no other.

    Words stand between ASCII white space, as in the filters before.
    """
    x, y = (t.encode("utf-8", "surrogatepass").split() for t in (a, b))
    n = max(len(x), len(y))
    return bool(x and y) and distance_within(x, y, int((1 - similarity) * n + 1e-9))


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2), batch.column(3)
        ok = [near(x.as_py(), y.as_py(), similarity) for x, y in zip(*texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _shared(member: DataFrame) -> tuple[DataFrame, int]:
    """Members of buckets with more than one, and how many pairs those buckets hold."""
    several = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = staged(member.join(several, "key"), "members")
    pairs = kept.agg(F.sum((F.col("n") - 1) / 2)).first()[0]
    return kept.drop("n"), int(np.ceil(pairs or 0))


def _open(member: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, doc, n_words, part) of the buckets whose members the links do not all join; part: the component."""
    root = components(linked).withColumnRenamed("node", "doc")
    parts = member.join(root.hint("merge"), "doc", "left").select("key", "doc", "n_words", F.coalesce("root", "doc").alias("part"))
    parts = staged(parts, "parts")
    unlike = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
    return staged(parts.join(unlike.select("key"), "key"), "open")


def _blocks(member: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: members (key, doc, n_words, part, bag) of one bucket and different parts whose lengths and bags allow it.

    Inside a bucket the work of comparing bags grows with the square of the unlike texts of a band (under a microsecond
    each); rows do not. A near pair's lengths lie in one band or in neighbouring ones, so a band meets itself and the next; a band of more than
    BLOCK members is dealt into groups, and a task compares the bags of two groups. Only what may be near leaves it.
    """
    band = F.floor(F.log(F.col("n_words").cast("double")) / float(-np.log(similarity)) + 1e-9)
    there = member.withColumn("cell", F.explode(F.array(band, band + 1))).withColumn("home", F.col("cell") == band)
    size = there.groupBy("key", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups"), F.max("home").alias("met")).filter("met").drop("met")
    there = there.hint("merge").join(size, ["key", "cell"]).withColumn("g", F.pmod(F.xxhash64("doc"), F.col("groups")))
    there = there.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumns({"i": F.least("g", "o"), "j": F.greatest("g", "o")})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        doc, part, n, home, g = (table[c].to_numpy() for c in ("doc", "part", "n_words", "home", "g"))
        bag = np.frombuffer(b"".join(table["bag"].to_pylist()), np.uint8).reshape(-1, BAG + FINE_BAG)
        inner, found = key[2].as_py() == key[3].as_py(), []
        for x in range(len(doc)):
            y = np.flatnonzero((part != part[x]) & (home | home[x]) & (doc > doc[x]))
            y = y[np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]) - 1e-9]
            if not inner:  # pairs inside a group are its own task's
                y = y[g[y] != g[x]]
            most = _most(np.maximum(n[y], n[x]), similarity)
            for kind in (slice(0, BAG), slice(BAG, None)):  # an edit takes at most one word from a bag
                ok = _apart(bag[y, kind], bag[x, kind]) <= most
                y, most = y[ok], most[ok]
            found += [(doc[x], b) for b in doc[y]]
        return pa.table([[a for a, _ in found], [b for _, b in found]], schema=PAIR)

    rows = there.select("key", "cell", "i", "j", "doc", "part", "n_words", "home", "g", "bag")
    return rows.groupBy("key", "cell", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidates(member: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of unsettled buckets, member (key, doc, n_words, part), whose words allow that they are near."""
    bag = staged(bags(texts.join(member.select("doc").distinct().hint("merge"), "doc", "left_semi")), "bags")
    return _blocks(member.hint("merge").join(bag, "doc"), similarity)


def links(found: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b), a < b, of distinct texts. found: sketches of distinct texts; docs: (doc, text)."""
    whole, left = _shared(found.select("doc", "n_words", F.explode("keys").alias("key")))
    # the sides of these joins grow with the data, so none is broadcast
    texts = staged(docs.join(whole.select("doc").distinct().hint("merge"), "doc", "left_semi").select("doc", "text"), "texts")
    done, member, turn = None, whole, 0

    def verified(pairs: DataFrame) -> DataFrame:
        if done is not None:
            pairs = pairs.join(done.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        both = pairs.hint("merge").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").hint("merge").join(
            texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b"
        )
        fresh = both.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify(it, similarity), "a bigint, b bigint, ok boolean")
        fresh = staged(fresh, "verified")
        return fresh if done is None else done.unionByName(fresh)

    while left and turn < LEADERS:
        # every bucket draws its own leader, so a document that joins one class can lead elsewhere
        drawn = F.min(F.struct(F.xxhash64("key", "doc", F.lit(turn)).alias("h"), F.col("doc").alias("leader"), F.col("n_words").alias("m")))
        leader = member.groupBy("key").agg(drawn.alias("l")).select("key", "l.leader", "l.m")
        led = staged(member.join(leader, "key").filter("doc != leader").withColumns({"a": F.least("doc", "leader"), "b": F.greatest("doc", "leader")}), "led")
        close = F.least("n_words", "m") >= similarity * F.greatest("n_words", "m") - 1e-9
        done = verified(led.filter(close).select("a", "b").distinct())
        member, left = _shared(led.join(done.filter("ok"), ["a", "b"], "left_anti").select("doc", "n_words", "key"))
        turn += 1
    if done is None:
        return docs.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    done = verified(staged(candidates(_open(whole, done.filter("ok").select("a", "b")), texts, similarity), "candidates"))
    return done.filter("ok").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating stars until no edge changes."""
    edges = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        new = staged(small.filter("a != b").distinct(), "edges")
        total = [x.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first() for x in (edges, new)]
        edges = new
        if total[0] == total[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, tables: int = TABLES, similarity: float = SIMILARITY
) -> DataFrame:
    """(key, class_id, n_copies, n_links) of every row: the least key of its class, the rows with its very text, and the
    verified links of its text to other texts.

    Equal texts are one text throughout and are led by their least key. Null counts as empty; texts without words are
    near to equal ones only. A text shorter than k words is one k-mer. Rows without a key get no class and are near to
    none. Repeated keys come out as often as they go in; a key that names several texts joins their classes. An empty
    table gives an empty result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.unhex(F.md5(body.cast("binary"))).alias("content"), body.alias("text"))
    rows = staged(sketches(docs.filter("doc is not null"), k, tables), "sketches")
    distinct = rows.groupBy("content").agg(
        F.min("doc").alias("doc"), F.min("n_words").alias("n_words"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("n_copies")
    )
    distinct = staged(distinct, "distinct")
    found = staged(links(distinct.select("doc", "n_words", "keys"), docs.select("doc", "text"), similarity), "links")
    root = components(found)
    count = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    led = distinct.select("content", "doc", "n_copies").join(root, F.col("doc") == F.col("node"), "left").drop("node")
    led = led.join(count, F.col("doc") == F.col("node"), "left").select(
        "content", F.coalesce("root", "doc").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = rows.select(F.col("doc").alias(key), "content").join(led, "content").drop("content")
    missing = docs.filter("doc is null").select(
        F.col("doc").alias(key), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")
    )
    return out.unionByName(missing)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows of `df` with one row of each class: the least key's, of several rows with that key the one of least text hash.

    Rows without a key stay.
    """
    lead = classes(df, key, text, **how).filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("_lead")).distinct()
    one = Window.partitionBy("_lead").orderBy(F.xxhash64(F.col(f"`{text}`")))
    kept = df.join(lead.hint("merge"), F.col(f"`{key}`") == F.col("_lead")).withColumn("_row", F.row_number().over(one)).filter("_row = 1")
    return kept.drop("_lead", "_row").unionByName(df.filter(F.col(f"`{key}`").isNull()))
