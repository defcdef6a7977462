"""N-gram Jaccard join: exact near-duplicate links and their components, by prefix filters under several token orders.

Sets are a text's distinct 5-word shingles. Of a document only shingles that another text holds too can link it, so one packed
exchange by shingle counts document frequencies and drops the rest, and a second one gathers what is left by text. A text goes on
only if four fifths of its shingles are shared. Every token order (frequency class, then a seeded hash) gives the text a prefix;
texts that link share a prefix token under each order. Buckets of the first order make candidates, the other orders filter them,
the survivors are verified exactly.

Groups of copies aren't expanded: equal texts are one set; in a few rounds each bucket offers its members to a hub and components
come from the links found. Only buckets that then still hold several components offer pairs, across components only, and only those
whose distances from a common hub allow a link (Jaccard distance is a metric) and whose parity bitmaps do: a shingle that only one of
two sets holds flips one bit, so the bits in which the bitmaps differ bound the shingles that aren't common from below. Every pair, of
the rounds and of the rest, must share a prefix token under the other orders too before its sets are fetched.

Token ids carry their frequency class, which says how large a bucket can be: the rows of large buckets are dealt over salts, and a bucket
whose members offer pairs is cut into groups of BLOCK members, a task's key being a pair of groups, so none sees all pairs of a bucket.
Shingles are compared by 48-bit hashes, texts by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c
from gapengine.llm.graph import components

#: A shingle in so many texts of one chunk is hot: only a mark goes to its bucket, and its texts keep it with the last frequency class.
HOT = 64
HOT_CLASS = 63
#: Bytes of text whose shingles a task holds at a time.
CHUNK = 2 << 20
#: Members of a bucket that offer pairs to as many others under one key, and rows of a bucket that are joined under one key.
BLOCK, ROWS = 256, 1024
#: Rounds in which buckets offer their members to a hub before the pairs that are left are listed.
ROUNDS = 2
SEEDS = (0x1B873593CC9E2D51, 0x85EBCA6B27D4EB2F)
_MAP = "bucket int, kind int, doc_id long, sid long, n long, payload binary"


def _tok6(tok: np.ndarray) -> bytes:
    return np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _untok6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _pack(sids: np.ndarray, ns: np.ndarray, runs: np.ndarray, tok: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    head = np.array([len(runs), len(tok)], np.uint32).tobytes()
    return head + sids.astype(np.uint64).tobytes() + ns.astype(np.uint32).tobytes() + runs.astype(np.uint32).tobytes() + _tok6(tok) + (b"" if extra is None else extra.astype(np.uint8).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sid, n, token and the extra byte, a row for each token."""
    r, t = np.frombuffer(data, np.uint32, 2)
    at = 8
    sids = np.frombuffer(data, np.uint64, r, at)
    ns = np.frombuffer(data, np.uint32, r, at + 8 * r)
    runs = np.frombuffer(data, np.uint32, r, at + 12 * r)
    at += 16 * int(r)
    tok = _untok6(data[at : at + 6 * int(t)])
    extra = np.frombuffer(data, np.uint8, -1, at + 6 * int(t))
    return np.repeat(sids, runs), np.repeat(ns, runs), tok, extra


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each run of equal numbers, and its length."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[at], np.diff(np.concatenate([at, [len(doc)]]))


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(n)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def shingled(n: int):
    """Kind 0: a document, its set's id and size. Kind 1: shingles and the sets that hold them, by shingle. Kind 2: hot shingles, by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = c.raw(batch), batch.column(0).to_pylist()
            for i, j in c.chunks(texts, CHUNK):
                tokens = [c.words(t) for t in texts[i:j]]
                lengths = np.fromiter(map(len, tokens), np.int64, j - i)
                doc = np.repeat(np.arange(j - i), lengths)
                h = c.hashed([w for t in tokens for w in t])
                sh, at = c.shingles(h, doc, lengths)
                key = np.unique((at.astype(np.uint64) << np.uint64(48)) | (sh >> np.uint64(16)))
                tok, doc = key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64)
                size = np.bincount(doc, minlength=j - i)
                sid = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(t)) for t in tokens), np.uint64, j - i)
                # documents are only passed on, so copies of a text needn't go to one bucket
                rows = [(b, 0, d, s, k, None) for b, d, s, k in zip(((_bucket(sid, n) + np.arange(j - i, dtype=np.uint64)) % np.uint64(n)).tolist(), ids[i:j], _signed(sid), size.tolist(), strict=True)]
                first = np.zeros(j - i, bool)  # copies in this chunk count once
                first[np.unique(sid, return_index=True)[1]] = True
                keep = first[doc]
                tok, doc = tok[keep], doc[keep]
                found, inverse, count = np.unique(tok, return_inverse=True, return_counts=True)
                hot = count >= HOT
                is_hot = hot[inverse]
                if hot.any():
                    for b, p in c.split_by(_bucket(found[hot], n), n):
                        rows.append((b, 1, None, None, None, _pack(np.zeros(1), np.zeros(1), np.array([len(p)]), found[hot][p], np.ones(len(p)))))
                    for b, p in c.split_by(_bucket(sid[doc[is_hot]], n), n):
                        d, r = _runs(doc[is_hot][p])
                        rows.append((b, 2, None, None, None, _pack(sid[d], size[d], r, tok[is_hot][p], np.full(len(p), HOT_CLASS))))
                tok, doc = tok[~is_hot], doc[~is_hot]
                for b, p in c.split_by(_bucket(tok, n), n):
                    d, r = _runs(doc[p])
                    rows.append((b, 1, None, None, None, _pack(sid[d], size[d], r, tok[p])))
                yield _table(rows, _ARROW)

    return run


def shared_tokens(n: int):
    """From all entries of a bucket's shingles: those that two sets at least hold, with the frequency class, by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, ns, toks, marks = [], [], [], []
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist())
            if (other := np.flatnonzero(kinds != 1)).size:
                yield batch.take(pa.array(other))
            for p in batch.column(5).take(pa.array(np.flatnonzero(kinds == 1))).to_pylist():
                s, k, t, extra = _unpack(p)
                if len(extra):
                    marks.append(t)
                else:
                    sids.append(s), ns.append(k), toks.append(t)
        if not toks:
            return
        sid, size, tok = c.joined(sids), c.joined(ns), c.joined(toks)
        order = np.lexsort((sid, tok))
        # one column after another: old and new copies of all of them at once would double a task's memory
        sid = sid[order]
        size = size[order]
        tok = tok[order]
        del order
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])])
        sid = sid[new]
        size = size[new]
        tok = tok[new]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        df = np.diff(np.concatenate([start, [len(tok)]]))
        klass = np.floor(np.log2(df)).astype(np.uint8)
        if marks:
            klass[np.isin(tok[start], np.concatenate(marks))] = HOT_CLASS
        klass = np.repeat(klass, df)
        keep = klass > 0
        sid, size, tok, klass = sid[keep], size[keep], tok[keep], klass[keep]
        order = np.argsort(sid, kind="stable")
        sid, size, tok, klass = sid[order], size[order], tok[order], klass[order]
        rows = []
        for b, p in c.split_by(_bucket(sid, n), n):
            s, r = _runs(sid[p])
            rows.append((b, 2, None, None, None, _pack(s, size[p][np.cumsum(r) - 1], r, tok[p], klass[p])))
        for i in range(0, len(rows), 64):
            yield _table(rows[i : i + 64], _ARROW)

    return run


#: 64-bit words of a set's parity bitmap.
WORDS = 8
_SETS = "sid long, n int, m int, p int, toks array<long>, second array<long>, third array<long>, bits array<long>"
_SETS_ARROW = pa.schema([("sid", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("p", pa.int32()), *((x, pa.list_(pa.int64())) for x in ("toks", "second", "third", "bits"))])


def _parity(tok: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set's shared shingles."""
    bit = (c.mixed(tok ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def prefixed(percent: int):
    """A row for each set that can have a link at all: its shared shingles in the first order, and the other orders' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for column, x in zip(columns, _unpack(p), strict=True):
                    column.append(x)
        if not columns[0]:
            return
        sid, size, tok, klass = map(c.joined, columns)
        order = np.lexsort((tok, klass, sid))
        sid, size, tok, klass = sid[order], size[order], tok[order], klass[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])])  # copies in several chunks bring hot shingles twice
        sid, size, tok, klass = sid[new], size[new], tok[new], klass[new]
        keys, m = _runs(sid)
        ends = np.cumsum(m)
        rows: list[tuple] = []
        for s, k, e in zip(keys.view(np.int64).tolist(), m.tolist(), ends.tolist(), strict=True):
            n = int(size[e - 1])
            least = -(-percent * n // 100)
            if k < least:
                continue
            p = (n - least + 1) - (n - k)
            kl = klass[e - k : e]
            t = tok[e - k : e] | (kl.astype(np.uint64) << np.uint64(48))
            rest = [t[np.lexsort((c.mixed(t ^ np.uint64(seed)), kl))[:p]].view(np.int64) for seed in SEEDS]
            rows.append((s, n, k, p, t.view(np.int64), *rest, _parity(t)))
            if len(rows) >= 512:
                yield _table(rows, _SETS_ARROW)
                rows = []
        if rows:
            yield _table(rows, _SETS_ARROW)

    return run


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) that share a prefix token under the other orders too, with both sizes in s and the exact overlap o. Whole sets are fetched for those only."""
    side = lambda x, *columns: sets.select(*[F.col(k).alias(f"{x}_{k}") for k in ("sid", *columns)])
    orders = ("second", "third")
    near = pairs.join(side("a", *orders), F.col("a") == F.col("a_sid")).join(side("b", *orders), F.col("b") == F.col("b_sid"))
    near = near.where(F.arrays_overlap("a_second", "b_second")).where(F.arrays_overlap("a_third", "b_third")).select("a", "b")
    both = near.join(side("a", "n", "toks"), F.col("a") == F.col("a_sid")).join(side("b", "n", "toks"), F.col("b") == F.col("b_sid"))
    return both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("s"), F.size(F.array_intersect("a_toks", "b_toks")).alias("o"))


def _salts(tok: Column) -> Column:
    """Over how many keys the rows of a token's bucket are dealt: by its frequency class, 2 ** class to 2 ** (class + 1) texts; the last class is of unknown size."""
    of = F.shiftright(tok, 48)
    return F.when(of == HOT_CLASS, F.lit(64)).when(of >= 10, F.least(F.lit(1024), F.pow(F.lit(2.0), of - 9).cast("int"))).otherwise(F.lit(1))


def _salted(df: DataFrame) -> DataFrame:
    """The rows of buckets, dealt over salts by their set."""
    return df.withColumn("salt", F.pmod(F.xxhash64("sid"), _salts(F.col("tok"))).cast("int"))


def _to_all_salts(df: DataFrame) -> DataFrame:
    """One row of each bucket, for all of its salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("tok")) - 1)))


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(100 * F.col("o") >= percent * (F.col("s") - F.col("o"))).select("a", "b")


def _stars(prefix: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of each set with at most two of the hubs of its buckets: the one that it shares most prefix tokens with, and the best hub.

    A bucket's hub is the member with the smallest share of shingles that no other text has: an original rather than one of its edited copies; seed varies the choice.
    Members that already have the hub's root aren't offered to it.
    """
    rank = F.struct(F.round((F.col("n") - F.col("m")) / F.col("n"), 2), F.xxhash64(F.lit(seed), "sid")) if seed == 0 else F.struct(F.xxhash64(F.lit(seed), "sid"))
    hubs = _to_all_salts(prefix.groupBy("tok", "band").agg(F.min_by(F.struct("sid", "n", "root", rank.alias("rank")), rank).alias("hub")))
    offered = prefix.select("sid", "n", "root", "tok", "salt", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).join(hubs, ["tok", "salt", "band"])
    offered = offered.where(F.col("root") != F.col("hub.root")).where(_fits(F.col("n"), F.col("hub.n"), percent))
    offered = offered.groupBy("sid", F.col("hub.sid").alias("hub")).agg(F.count("*").alias("k"), F.min("hub.rank").alias("rank"))
    best = offered.groupBy("sid").agg(F.max_by("hub", F.struct("k", "hub")).alias("x"), F.min_by("hub", "rank").alias("y"))
    return best.select("sid", F.explode(F.array_distinct(F.array("x", "y"))).alias("hub"))


def _fits(x, y, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _labelled(rows: DataFrame, links: DataFrame, scratch: c.Scratch) -> DataFrame:
    """The rows of buckets that still hold several roots, with the roots that the links give and the number of a bucket's rows in k."""
    roots = components(links).select(F.col("v").alias("sid"), F.col("root").alias("new"))
    out = rows.drop("root", "k").join(roots, "sid", "left").withColumn("root", F.coalesce("new", "sid")).drop("new")
    several = out.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("tok", "k")
    return scratch.written(out.join(_to_all_salts(several), ["tok", "salt"]), "open")


def _links(sets: DataFrame, percent: int, scratch: c.Scratch) -> DataFrame:
    """Enough links between sets for their components: edges (a, b)."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / percent))).cast("int")
    prefix = _salted(sets.select("sid", "n", "m", F.col("sid").alias("root"), band.alias("band"), F.posexplode(F.slice("toks", F.lit(1), F.col("p"))).alias("pos", "tok")))
    shared = prefix.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1").select("tok")
    prefix = scratch.written(prefix.join(_to_all_salts(shared), ["tok", "salt"], "left_semi"), "prefix")
    links = distances = None
    for seed in range(ROUNDS):
        seen = scratch.written(_overlaps(_stars(prefix, percent, seed).select(F.col("sid").alias("a"), F.col("hub").alias("b")), sets), "stars")
        links = _linked(seen, percent) if links is None else links.unionByName(_linked(seen, percent))
        away = seen.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), (1 - F.col("o") / (F.col("s") - F.col("o"))).alias("d"))
        distances = away if distances is None else distances.unionByName(away)
        prefix = _labelled(prefix, links, scratch)

    # each set's distances from its hubs, two in a round at most: two sets that link differ in them by no more than the links' distance
    hubs = distances.select(F.col("pivot").alias("sid"), "pivot", F.lit(0.0).alias("d")).distinct()
    pivots = distances.unionByName(hubs).groupBy("sid").agg(F.map_from_entries(F.collect_set(F.struct("pivot", "d"))).alias("from"))
    # a bucket's k rows fall into ceil(k / BLOCK) groups; a row meets each group under a key of both groups' numbers
    groups = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = prefix.withColumns({"own": F.pmod(F.xxhash64(F.lit(11), "sid"), groups).cast("int"), "other": F.explode(F.sequence(F.lit(0), groups - 1))})
    rows = rows.join(sets.select("sid", "bits"), "sid")
    own = ("sid", "n", "m", "pos", "root", "bits")
    x = rows.select("tok", "band", F.col("own").alias("g"), F.col("other").alias("h"), *[F.col(k).alias(f"x_{k}") for k in own])
    y = rows.select("tok", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("other").alias("g"), F.col("own").alias("h"), *[F.col(k).alias(f"y_{k}") for k in own])
    reach = F.least("x_pos", "y_pos") + 1 + F.least(F.expr("x_m - x_pos - 1"), F.expr("y_m - y_pos - 1"))
    near = (F.col("x_root") < F.col("y_root")) & _fits(F.col("x_n"), F.col("y_n"), percent) & ((100 + percent) * reach >= percent * (F.col("x_n") + F.col("y_n")))
    apart = sum((F.bit_count(F.col("x_bits")[k].bitwiseXOR(F.col("y_bits")[k])) for k in range(1, WORDS)), F.bit_count(F.col("x_bits")[0].bitwiseXOR(F.col("y_bits")[0])))
    near &= (100 + percent) * (F.col("x_m") + F.col("y_m") - apart) >= 2 * percent * (F.col("x_n") + F.col("y_n"))
    pairs = x.join(y, ["tok", "band", "g", "h"]).where(near).select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b")).distinct()
    # distances are fetched once for each pair, not once for each prefix token
    for z in "ab":
        pairs = pairs.join(pivots.select(F.col("sid").alias(z), F.col("from").alias(f"{z}_from")), z, "left").withColumn(f"{z}_from", F.coalesce(f"{z}_from", F.create_map().cast("map<long,double>")))
    near = F.forall(F.map_keys("a_from"), lambda p: F.coalesce(F.abs(F.col("a_from")[p] - F.col("b_from")[p]) <= 1 - percent / 100 + 1e-9, F.lit(True)))
    rest = pairs.where(near).select("a", "b")
    return links.unionByName(scratch.written(_linked(_overlaps(rest, sets), percent), "links"))


def jaccard_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * |A and B| >= percent * |A or B|.

    Null, empty and blank texts have an empty set and stand alone. Repeated rows and equal texts fall together; a null doc_id
    takes part and gets the least non-null id of its component (null if there is none). Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = c.partitions(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = c.Scratch(spark)
    entries = c.by_id(plain.mapInArrow(c.lean(shingled(n)), _MAP), n)
    table = scratch.written(entries.mapInArrow(c.lean(shared_tokens(n)), _MAP), "shared")
    packed = c.by_id(table.where("kind = 2").select("payload", "bucket"), n).select("payload")
    sets = scratch.written(packed.mapInArrow(c.lean(prefixed(percent)), _SETS), "sets")
    members = c.written(table.where("kind = 0").select("doc_id", "sid", "n"), "members")
    scratch.drop("shared")
    roots = components(_links(sets, percent, scratch)).select(F.col("v").alias("sid"), "root")
    scratch.drop(*list(scratch.paths))

    texts = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    texts = texts.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = texts.groupBy("root").agg(F.min("least").alias("component_id"))
    texts = texts.join(least, "root").select("sid", "component_id")
    full = members.where("n > 0").join(texts, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The document with the least doc_id of each component, all its columns. Of repeated rows of that document one stays; rows without a doc_id stay."""
    keep = jaccard_components(docs, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    if not again.isEmpty():
        again = c.checkpointed(again)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
