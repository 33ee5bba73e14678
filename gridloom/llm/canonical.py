"""Canonical exact digest.

A text's canonical form is its compatibility composition, case-folded, with each run of Unicode white space as one
space and none at the ends; its digest is the 128-bit XXH3 of that form. Documents with equal
digests form a bucket, and in a bucket the forms are compared byte by byte: should two differ, the
later form's fingerprint gets a number. Likeness is 1 if the forms are equal and 0 if not, and so are
fingerprints. An edited text whose digest is that of other forms takes the number of the form equal to it (told by
the SHA-256), or one of its own.

For the edited texts every document meets its successor by doc_id: blocks are ranges of doc_id cut at
ids that occur, an id of very many rows (as null may be) also at hashes of text that occur. The rows of a block's
first id and hash are sent to the block before it as well, so the texts are exchanged once. Only
forms in buckets of two or more rows are exchanged again, one
representative for each block and form, however many copies there are.

Defined results: null text counts as empty. Rows of equal doc_id follow each other in the order of
their texts' hashes; a null doc_id comes first. A lone row is its own successor. Repeated rows are
fingerprinted alike. No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import block_count, scratch, slices
from .exact_dedup import grace
from .histogram_sort import LOW

BLOCK_BYTES = 5 << 20


def canonical(text: str) -> bytes:
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> bytes:
    return xxh3_128_digest(form)


def _digests(hashed: Callable[[bytes], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashed(canonical(t or "")) for t in b.column(2).to_pylist()], pa.binary())], names=["i", "h", "digest"])

    return run


@dataclass(frozen=True)
class Cuts:
    """Where blocks start: ids, ascending, and hashes of text within an id (LOW: all of it)."""

    ids: np.ndarray
    hashes: np.ndarray

    def block(self, i: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, i, side="left"), np.searchsorted(self.ids, i, side="right")
        out = high - 1
        several = high - low > 1
        for a in np.unique(low[several]).tolist():
            rows = several & (low == a)
            stop = int(high[rows][0])
            out[rows] = a + np.searchsorted(self.hashes[a:stop], h[rows], side="right") - 1
        return out

    def starts(self, block: np.ndarray, i: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether a row may be its block's first."""
        return (self.ids[block] == i) & ((self.hashes[block] == LOW) | (self.hashes[block] == h))


def _least(edges: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The smallest id at or after each edge and before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.sort(b.column(0).to_numpy())
            cell = np.searchsorted(edges, i, side="right") - 1
            new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(i) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[new].astype(np.int32)), pa.array(i[new])], names=["cell", "i"])

    return run


def cuts_of(slim: DataFrame, blocks: int) -> Cuts:
    """Cuts near the quantiles of the ids, at ids that occur. An id that fills several blocks is cut at quantiles of its texts' hashes."""
    marks = F.percentile_approx("i", F.array(*[F.lit(k / blocks) for k in range(1, blocks)] or [F.lit(0.5)]), F.lit(max(10_000, 20 * blocks)))
    cut = slim.agg(F.min("i").alias("low"), marks.alias("marks")).first()
    if cut["low"] is None:
        return Cuts(np.array([LOW], np.int64), np.array([LOW], np.int64))
    times = Counter(cut["marks"])
    if max(abs(i) for i in times) >= 1 << 53 and set(times) != {LOW}:  # quantiles are doubles: take the ids that occur next
        edges = np.array(sorted(times), np.int64)
        met = slim.select("i").mapInArrow(_least(edges), "cell int, i long").groupBy("cell").agg(F.min("i").alias("i")).collect()
        times = Counter({r["i"]: times[int(edges[r["cell"]])] for r in met if r["cell"] >= 0})
    pairs = {(i, LOW) for i in (cut["low"], *times)}
    heavy = [i for i, n in times.items() if n > 1]  # at most half as many as there are blocks
    if heavy:
        shares = F.array(*[F.lit(k / 64) for k in range(1, 64)]) if max(times.values()) < 64 else F.array(*[F.lit(k / max(times.values())) for k in range(1, max(times.values()))])
        rows = slim.join(F.broadcast(slim.sparkSession.createDataFrame([(i,) for i in heavy], "i long")), "i")
        for r in rows.groupBy("i").agg(F.percentile_approx("h", shares, F.lit(10_000)).alias("marks"), F.min("h").alias("low")).collect():
            step = max(1, round(len(r["marks"]) / (times[r["i"]] + 1)))
            pairs |= {(r["i"], h) for h in r["marks"][step - 1 :: step] if h > r["low"]}
    return Cuts(*(np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)))


def _dealt(cuts: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """i, h, doc_id, text -> block and role in front: 0 in the own block, 1 as what follows the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            block = cuts.block(i, h).astype(np.int32)
            first = cuts.starts(block, i, h)
            for role, rows, own in ((0, b, block), (1, b.filter(pa.array(first)), (block[first] - 1) % len(cuts.ids))):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), role, np.int32)), *rows.columns], names=["block", "role", *rows.schema.names])

    return run


def _blocked(cuts: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = cuts.block(*(c.to_numpy() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *b.columns], names=["block", "i", "h"])

    return run


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.binary()), ("check", pa.binary()), ("edited_digest", pa.binary()), ("edited_check", pa.binary()),
    ("like_next", pa.bool_()), ("like_edited", pa.bool_()), ("rep", pa.binary()), ("form", pa.binary()),
])


def _block(docs: pa.Table, shared: pa.Table, hashed: Callable[[bytes], bytes]) -> pa.Table:
    """Fingerprint a block's texts and edited texts; forms whose digest occurs elsewhere are carried along, one row a form."""
    docs = docs.sort_by([("role", "ascending"), ("i", "ascending"), ("h", "ascending"), ("text", "ascending")])
    role = docs["role"].to_numpy()
    n = int((role == 0).sum())
    if not n:
        return _ROW.empty_table()
    meets = set(zip(shared["i"].to_pylist(), shared["h"].to_pylist(), strict=True))
    ids, keys, hashes, texts = (docs[c].to_pylist() for c in ("doc_id", "i", "h", "text"))
    reps: dict[bytes, bytes] = {}
    rows = []
    sha = lambda x: hashlib.sha256(x).digest()
    text = texts[0] or ""
    form = canonical(text)
    for k in range(n):
        following = texts[k + 1] or ""  # behind the last stands what follows the block
        next_form = canonical(following)
        keep = len(text) - len(text) // 4
        edited = text[:keep] + following[: len(text) // 4]
        edited_form = canonical(edited)
        rep = carried = None
        if (keys[k], hashes[k]) in meets:
            if form not in reps:
                reps[form], carried = uuid.uuid4().bytes, form
            rep = reps[form]
        rows.append((ids[k], len(text), hashlib.sha256(edited.encode()).hexdigest(), hashed(form), sha(form), hashed(edited_form), sha(edited_form), form == next_form, form == edited_form, rep, carried))
        text, form = following, next_form
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in slices(batches):
            yield from ((rep, d + d, form) for rep, d, form in zip(*(c.to_pylist() for c in b.columns), strict=True))

    found = list(grace(records()))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["rep", "class"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, hashed: Callable[[bytes], bytes] = digest) -> DataFrame:
    """Every row as doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and group_id, the smallest doc_id with the same form."""
    own = F.col(doc_id).cast("long")
    words = F.col(text).cast("string")
    slim = docs.select(F.coalesce(own, F.lit(LOW)).alias("i"), F.shiftright(F.xxhash64(words), 11).alias("h"), own.alias("doc_id"), words.alias("text"))
    cuts = cuts_of(slim, block_count(slim, block_bytes))

    digests = scratch(slim.select("i", "h", "text").mapInArrow(_digests(hashed), "i long, h long, digest binary"), "digests")
    several = scratch(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "shared-digests")  # stored, so Spark can split a digest of many rows in the join
    shared = digests.join(several, "digest").select("i", "h").mapInArrow(_blocked(cuts), "block int, i long, h long").distinct()
    dealt = slim.mapInArrow(_dealt(cuts), "block int, role int, i long, h long, doc_id long, text string")
    schema = "doc_id long, n_chars long, edited_sha256 string, digest binary, check binary, edited_digest binary, edited_check binary, like_next boolean, like_edited boolean, rep binary, form binary"
    rows = scratch(dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(partial(_block, hashed=hashed), schema), "canonical")

    forms = rows.filter("form is not null").select("rep", "digest", "form")
    classes = forms.repartition(block_count(forms, block_bytes, least=4), "digest").mapInArrow(_classes, "rep binary, class binary")
    reps = scratch(rows.filter("rep is not null").groupBy("rep", "digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("low")).join(classes, "rep"), "canonical-reps")
    groups = reps.groupBy("digest", "class").agg(F.min("low").alias("low"))
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("low", "class")) - 1)
    placed = reps.select("rep", "class").join(groups, "class").select("rep", F.col("low.doc_id").alias("group_id"), "number")
    out = rows.drop("form").join(placed, "rep", "left").withColumn("number", F.coalesce("number", F.lit(0)))
    edited = _edited_numbers(rows, out)
    out = out.join(edited, ["edited_digest", "edited_check"], "left")
    name = lambda d, n: F.concat(F.lower(F.hex(d)), F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))
    same = lambda c: F.col(c).cast("double")
    number = F.when(F.col("like_edited"), F.col("number")).otherwise(F.coalesce("edited_number", F.lit(0)))
    return out.select("doc_id", "n_chars", "edited_sha256", name("digest", F.col("number")).alias("fingerprint"), name("edited_digest", number).alias("edited_fingerprint"), same("like_edited").alias("near_edited"), same("like_next").alias("near_next"), F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def _edited_numbers(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Numbers of edited forms whose digest is that of another form as well; as a rule there are none."""
    edited = rows.select(F.col("edited_digest").alias("digest"), F.col("edited_check").alias("check"))
    checks = rows.select("digest", "check").unionByName(edited).groupBy("digest").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    crowded = scratch(checks.filter("a <> b").select("digest"), "crowded-digests")
    own = named.join(crowded, "digest").groupBy("digest", "check").agg(F.min("number").alias("number"))
    last = own.groupBy("digest").agg(F.max("number").alias("last"))
    rest = edited.join(crowded, "digest").distinct().join(own, ["digest", "check"], "left_anti").join(last, "digest", "left")
    more = rest.select("digest", "check", (F.row_number().over(Window.partitionBy("digest").orderBy("check")) + F.coalesce("last", F.lit(-1))).alias("number"))
    return own.unionByName(more).select(F.col("digest").alias("edited_digest"), F.col("check").alias("edited_check"), F.col("number").alias("edited_number"))
