"""The history of problem 6 kept in a folder, so that a new batch is checked without reprocessing what came before.

Every batch adds one immutable segment: `copies` (exact texts with the first row of their posting), `boards` (ids of
boards) and `arrays`, pieces of at most PIECE texts with their words one after another and the sorted suffixes of these. A
segment is divided by leading bits of the block's hash into buckets of about PER_BUCKET rows, so that a batch reads a
bounded part of it for each block that it has, however long the history is. `fan` segments of a level are merged into one of
the next, so that there are about log(batches) of them and each row is rewritten about as often.

Which segments there are is said by numbered lists in `log`. A batch is part of the history once its list is there,
whole or not at all; lists are only ever created, so that of two writers at a time one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, parts_for, shared_dir, table
from .history import SHARED, Segment, Texts, near_copies, shared, tokens_of, with_keys, words_of

#: Rows of a bucket that a segment is divided for, texts of a piece, and buckets that are asked for by number.
PER_BUCKET, PIECE, MOST_TOUCHED = 20_000, 5_000, 5_000

_SCHEMAS = {
    "copies": "block binary, text binary, first_id long, bucket int",
    "boards": "board binary, first_id long, lost boolean, bucket int",
    "arrays": "bucket int, gid array<long>, first_id array<long>, block array<long>, offsets array<int>, words array<int>, suffixes array<int>",
}
_ARRAYS = "bucket int, gid array<long>, first_id array<long>, block array<long>, offsets array<int>, words array<int>, suffixes array<int>"


@dataclass(frozen=True)
class Part:
    """A segment: its folder below `data`, level, bits of its buckets and rows."""

    name: str
    level: int
    bits: int
    rows: int


def bits_for(rows: int) -> int:
    """Leading bits of buckets of about PER_BUCKET rows, 20 at most."""
    return min(20, max(0, (rows // PER_BUCKET).bit_length()))


def bucket_of(hashed: Column, bits: int) -> Column:
    """The bucket of a block or board, from its hash."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int") if bits else F.lit(0)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], piece: int, sort: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _ARRAYS from rows (bucket, salt, block, gid, first_id, words) sorted by bucket and salt; a piece never mixes buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("gid", pa.list_(pa.int64())), ("first_id", pa.list_(pa.int64())), ("block", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("suffixes", pa.list_(pa.int32()))])

    def flush(rows: pa.Table) -> pa.RecordBatch:
        words, offsets = _lists(rows["words"])
        block = rows["block"].to_numpy()
        t = Texts(block, words.astype(np.int64) & 0xFFFFFFFF, offsets)
        order = Segment(t, 0, len(block)).order if sort else np.zeros(0, np.int64)
        lists = [rows["gid"].to_numpy(), rows["first_id"].to_numpy(), block, offsets.astype(np.int32), words.astype(np.int32), order.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([rows["bucket"][0].as_py()], pa.int32()), *[pa.array([x], f.type) for x, f in zip(lists, list(schema)[1:])]], schema=schema)

    waiting: list[pa.Table] = []
    held, at = 0, None
    for b in batches:
        t = pa.Table.from_batches([b])
        buckets = t["bucket"].to_numpy()
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1), len(buckets)]
        for x, y in zip(cuts, cuts[1:]):
            while x < y:
                if waiting and (buckets[x] != at or held >= piece):
                    yield flush(pa.concat_tables(waiting))
                    waiting, held = [], 0
                at = buckets[x]
                n = min(int(y - x), piece - held)
                waiting.append(t.slice(x, n))
                held += n
                x += n
    if waiting:
        yield flush(pa.concat_tables(waiting))


def to_pieces(texts: DataFrame, bits: int, piece: int = PIECE, sort: bool = True) -> DataFrame:
    """_ARRAYS rows of texts (block, gid, first_id, words); a bucket of many texts is made in several tasks."""
    rows = texts.withColumn("bucket", bucket_of(F.col("block"), bits))
    many = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * piece)).cast("int").alias("tasks"))
    rows = rows.join(many, "bucket").withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("tasks"))).select("bucket", "salt", "block", "gid", "first_id", "words")
    return rows.repartition(parts_for(texts, 1), "bucket", "salt").sortWithinPartitions("bucket", "salt", "gid").mapInArrow(lambda it: _pieces(it, piece, sort), _ARRAYS)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, root) of the texts of a batch's piece that repeat one of a stored piece, with that one's first row."""
    names = ("gid", "first_id", "block", "offsets", "words", "suffixes")
    for b in batches:
        for row in pa.Table.from_batches([b]).to_batches(max_chunksize=1):
            old, new = ({n: row.column(f"{side}_{n}")[0].values.to_numpy(zero_copy_only=False) for n in names} for side in ("old", "new"))
            n = len(old["gid"])
            words = np.concatenate([old["words"], new["words"]]).astype(np.int64) & 0xFFFFFFFF
            t = Texts(np.concatenate([old["block"], new["block"]]), words, np.append(old["offsets"], new["offsets"][1:].astype(np.int64) + int(old["offsets"][-1])))
            stored = Segment(t, 0, n, old["suffixes"].astype(np.int64))
            out = []
            for pairs in stored.matches(t, t.places(n, len(t.block))):
                a, c = t.length[pairs].T
                pairs = pairs[np.minimum(a, c) >= SHARED * np.maximum(a, c) - 1e-6]
                pairs = pairs[shared(t, pairs) >= SHARED] if len(pairs) else pairs
                out.append(pairs[shared(t, pairs[:, ::-1]) >= SHARED] if len(pairs) else pairs)
            found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(new["gid"][found[:, 0] - n]), pa.array(old["first_id"][found[:, 1]])], ["gid", "root"])


class History:
    """All batches so far, in `folder` (on storage that the cluster shares)."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = 4) -> None:
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self) -> int:
        fs, p = self._fs(f"{self.folder}/log")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=0) if fs.exists(p) else 0

    def parts(self) -> list[Part]:
        """The segments that there are now."""
        n = self._version()
        if not n:
            return []
        fs, p = self._fs(f"{self.folder}/log/{n:012d}.json")
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [Part(**x) for x in json.loads(text)]

    def segments(self) -> dict[int, list[str]]:
        """Names of the segments by level."""
        out: dict[int, list[str]] = {}
        for x in self.parts():
            out.setdefault(x.level, []).append(x.name)
        return out

    def _commit(self, parts: list[Part], version: int) -> None:
        """Make `parts` list number `version`; fails if another writer made it first. A list is written aside and renamed, so
        that it is never read in part."""
        fs, p = self._fs(f"{self.folder}/log/{version:012d}.json")
        _, aside = self._fs(f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps([asdict(x) for x in parts]).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(aside, p):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer has made version {version} of {self.folder}")

    def _read(self, part: Part, name: str, touched: dict[int, list[int] | None]) -> DataFrame | None:
        """A segment's table, of the touched buckets only; None where there is nothing to read."""
        at = f"{self.folder}/data/{part.name}/{name}"
        fs, p = self._fs(at)
        wanted = touched.get(part.bits) if touched else None
        if not fs.exists(p) or (wanted is not None and not wanted):
            return None
        df = self.spark.read.schema(_SCHEMAS[name]).parquet(at)
        return df if wanted is None else df.filter(F.col("bucket").isin(*wanted))

    def _read_all(self, parts: list[Part], name: str, touched: dict[int, list[int] | None]) -> DataFrame:
        found = [x for x in (self._read(p, name, touched) for p in parts) if x is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], _SCHEMAS[name])

    def _touched(self, hashed: DataFrame, parts: list[Part]) -> dict[int, list[int] | None]:
        """For each number of bits that segments have, the buckets of the hashes `h`; None is all, where they are many."""
        out: dict[int, list[int] | None] = {}
        for bits in sorted({p.bits for p in parts}):
            got = [r[0] for r in hashed.select(bucket_of(F.col("h"), bits)).distinct().limit(MOST_TOUCHED + 1).collect()]
            out[bits] = got if len(got) <= MOST_TOUCHED else None
        return out

    def _write(self, level: int, rows: int, copies: DataFrame, boards: DataFrame, texts: DataFrame) -> Part:
        """A new segment's files; it is no part of the history before _commit()."""
        part = Part(uuid.uuid4().hex, level, bits_for(rows), rows)
        at = f"{self.folder}/data/{part.name}"
        copies.withColumn("bucket", bucket_of(F.xxhash64("block"), part.bits)).repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/copies")
        boards.withColumn("bucket", bucket_of(F.xxhash64("board"), part.bits)).repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/boards")
        to_pieces(texts, part.bits).write.partitionBy("bucket").parquet(f"{at}/arrays")
        return part

    def _merge(self, parts: list[Part]) -> tuple[list[Part], list[Part]]:
        """(segments after merging, segments that are no longer needed): levels of `fan` segments become one of the next."""
        spare: list[Part] = []
        level = 0
        while level <= max(p.level for p in parts):
            peers = [p for p in parts if p.level == level]
            if len(peers) >= self.fan:
                copies = self._read_all(peers, "copies", {}).groupBy("block", "text").agg(F.min("first_id").alias("first_id"))
                boards = self._read_all(peers, "boards", {}).groupBy("board", "lost").agg(F.min("first_id").alias("first_id"))
                arrays = self._read_all(peers, "arrays", {})
                each = F.explode(F.transform(F.sequence(F.lit(0), F.size("gid") - 1), lambda i: F.struct(
                    F.get("block", i).alias("block"), F.get("gid", i).alias("gid"), F.get("first_id", i).alias("first_id"),
                    F.slice("words", F.get("offsets", i) + 1, F.get("offsets", i + 1) - F.get("offsets", i)).alias("words"),
                )))
                texts = arrays.filter(F.size("gid") > 0).select(each.alias("x")).select("x.*")
                parts = [p for p in parts if p not in peers] + [self._write(level + 1, sum(p.rows for p in peers), copies, boards, texts)]
                spare += peers
            level += 1
        return parts, spare

    def append(self, rows: DataFrame) -> DataFrame:
        """(id, first_id) of a batch's rows, as history.first_rows() gives them over all batches; then the batch is part
        of the history. Ids must rise from batch to batch. An empty batch changes nothing."""
        version, parts = self._version(), self.parts()
        rows = rows.filter(F.col("id").isNotNull())
        keyed = materialize(with_keys(rows), "batch")
        placed, lost = keyed.filter("block IS NOT NULL"), keyed.filter("block IS NULL")
        blocks_touched = self._touched(placed.select(F.xxhash64("block").alias("h")), parts)
        boards_touched = self._touched(keyed.filter("board IS NOT NULL").select(F.xxhash64("board").alias("h")), parts)
        mine = placed.groupBy("block", "text").agg(F.min("id").alias("gid"))
        known = self._read_all(parts, "copies", blocks_touched).groupBy("block", "text").agg(F.min("first_id").alias("first_id"))
        mine = materialize(mine.join(known, ["block", "text"], "left"), "copies")
        fresh = mine.filter("first_id IS NULL").select(F.xxhash64("block").alias("block"), F.col("gid").alias("id"))
        texts = rows.select("id", "description").join(fresh, "id").dropDuplicates(["id"]).select("block", F.col("id").alias("gid"), words_of(F.col("description")).alias("words"))
        texts = materialize(texts, "texts")
        coded = texts.select("block", "gid", F.col("gid").alias("first_id"), F.transform(tokens_of("words"), lambda w: F.hash(w)).alias("words"))
        links = self._links(coded, parts, blocks_touched)
        several = texts.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        near = near_copies(materialize(texts.join(several, "block"), "both"))
        # texts alike within the batch, then the first row of what any of them repeats
        heads = texts.select("gid").join(near, "gid", "left").select("gid", F.coalesce("root", "gid").alias("root"))
        before = heads.join(links, "gid").groupBy("root").agg(F.min("of").alias("of"))
        roots = heads.join(before, "root", "left").select("gid", F.coalesce("of", "root").alias("root"))
        decided = mine.join(roots, "gid", "left").select("block", "text", "gid", F.col("first_id").isNull().alias("new"), F.coalesce("first_id", "root", "gid").alias("first_id"))
        decided = materialize(decided, "decided")
        found = materialize(placed.join(decided.select("block", "text", "first_id"), ["block", "text"]).select("id", "board", "first_id"), "found")
        # rows without a city belong to their board's posting, stored or of this batch
        stored = self._read_all(parts, "boards", boards_touched).groupBy("board").agg(F.min("first_id").alias("stored"), F.min(F.when(F.col("lost"), F.col("first_id"))).alias("lost_before"))
        stored = materialize(stored.join(keyed.select("board").distinct(), "board", "left_semi"), "boards")
        here = found.filter("board IS NOT NULL").groupBy("board").agg(F.min("first_id").alias("here"))
        lost_here = lost.filter("board IS NOT NULL").groupBy("board").agg(F.min("id").alias("lost_id"))
        least = found.select("board", "first_id").join(lost_here, "board", "left").join(stored.select("board", "lost_before"), "board", "left")
        moved = least.groupBy("first_id").agg(F.min(F.least("lost_id", "lost_before")).alias("to")).filter(F.col("to") < F.col("first_id"))
        moved = materialize(moved, "moved")
        placed_out = found.join(moved, "first_id", "left").select("id", "board", F.coalesce("to", "first_id").alias("first_id"))
        of = lost_here.join(here, "board", "left").join(stored, "board", "left").select("board", F.least("lost_id", "here", "stored").alias("of"))
        lost_out = lost.join(of, "board", "left").select("id", "board", F.coalesce("of", "id").alias("first_id"))
        out = materialize(placed_out.withColumn("lost", F.lit(False)).union(lost_out.withColumn("lost", F.lit(True))), "out")
        n = keyed.count()
        if n:
            final = decided.filter("new").join(moved, "first_id", "left").select("block", "text", "gid", F.coalesce("to", "first_id").alias("first_id"))
            kept = coded.drop("first_id").join(final.select("gid", "first_id"), "gid").select("block", "gid", "first_id", "words")
            boards = out.filter("board IS NOT NULL").groupBy("board", "lost").agg(F.min("first_id").alias("first_id"))
            parts, spare = self._merge([*parts, self._write(0, n, final.drop("gid"), boards, kept)])
            self._commit(parts, version + 1)
            for p in spare:
                fs, path = self._fs(f"{self.folder}/data/{p.name}")
                fs.delete(path, True)
        return out.select("id", "first_id")

    def _links(self, coded: DataFrame, parts: list[Part], touched: dict[int, list[int] | None]) -> DataFrame:
        """(gid, of): the first row of every stored posting that a new text repeats."""
        found = None
        side = lambda df, s: df.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "bucket"])
        new = {bits: materialize(to_pieces(coded, bits, sort=False), "pieces") for bits in {p.bits for p in parts}}
        for p in parts:
            old = self._read(p, "arrays", touched)
            if old is not None:
                both = side(old, "old").join(side(new[p.bits], "new"), "bucket").mapInArrow(_search, "gid long, root long")
                found = both if found is None else found.union(both)
        if found is None:
            return self.spark.createDataFrame([], "gid long, of long")
        return found.groupBy("gid").agg(F.min("root").alias("of"))

    def drop(self) -> None:
        """Delete the whole history."""
        fs, p = self._fs(self.folder)
        fs.delete(p, True)


def p6_batches(spark: SparkSession, root: str, last: int = 3) -> DataFrame:
    """The rows of p6_found, found batch by batch: all batches but the `last` ones are one first load of a new history, the
    others are appended one by one. A batch is the rows from a run's first id up to the next run's."""
    raw = table(spark, root, "raw_ingested_jobs").select("id", "ingestion_run_id", "source", "external_id", "title", "company", "city", "description")
    firsts = raw.filter("id IS NOT NULL").groupBy("ingestion_run_id").agg(F.min("id").alias("id")).orderBy(F.desc("id")).limit(last).collect()
    cuts = [None, *sorted(r["id"] for r in firsts), None]
    history = History(spark, f"{shared_dir(spark)}/laborloom/history-{uuid.uuid4().hex}")
    found = []
    for a, b in zip(cuts, cuts[1:]):
        batch = raw if a is None else raw.filter(F.col("id") >= a)
        found.append(history.append(batch if b is None else batch.filter(F.col("id") < b)))
    history.drop()
    out = reduce(DataFrame.unionByName, found)
    return out.filter(F.col("first_id") < F.col("id")).select("first_id", F.col("id").alias("dup_id"))
