"""Token counts by overlap resynchronisation.

Texts up to `chunk_chars` are counted whole. A longer one is cut into chunks that overlap by `overlap_chars`; the chunks are
spread over the cluster and encoded with offsets, each on its own. Two neighbours are spliced at the first position of their
overlap that both prove stable: a space in the text that no token of either side crosses and after which both give the same
next token. The tokenizer carries nothing over a space (see `pieces`), so left of it the left chunk and right of it the
right chunk give just what the whole text would; texts for a tokenizer that might carry something over are not cut. Where an overlap has no such position, the text is cut anew with chunks and
overlaps eight times as wide, until one chunk holds it all; no text is ever guessed at.

Cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are counted one by one;
an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import slices, written
from .pieces import encoder

_CHUNKS = "rid string, doc_id long, n_bytes long, chunk int, at long, chars long, text string"
_ENDS = "rid string, doc_id long, n_bytes long, chunk int, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(enc.count(b["text"].to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(step: int, overlap: int, fresh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int32()), ("at", pa.int64()), ("chars", pa.int64()), ("text", pa.string())])
        seen, part = 0, TaskContext.get().partitionId()
        for b in slices(batches, "text"):
            for row in b.to_pylist():
                text, rid = row["text"], f"{part}-{seen}" if fresh else row["rid"]
                seen += 1
                rows = [
                    {"rid": rid, "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "chunk": k, "at": at, "chars": len(text), "text": text[at : at + step + overlap]}
                    for k, at in enumerate(range(0, max(len(text) - overlap, 1), step))
                ]
                for k in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 16], schema)

    return run


def _encode_chunks(path: str, step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = pa.list_(pa.int64())
        schema = pa.schema([("rid", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int32()), ("n", pa.int64()), *((c, kind) for c in ("left_at", "left_n", "right_at", "right_n"))])
        for b in slices(batches, "text"):
            out = []
            for row in b.to_pylist():
                text, at = row["text"], row["at"]
                e = enc.library.encode(text, add_special_tokens=False)
                spans = e.offsets
                edges = lambda lo, hi: _stable(text, spans, e.ids, lo, hi)
                left = edges(0, overlap) if row["chunk"] else []
                right = edges(step, step + overlap) if at + len(text) < row["chars"] else []
                # the next token is part of the position's name, so that both sides must agree on it too
                name = lambda p, nxt: (at + p) * (1 << 20) + nxt
                out.append(
                    {k: row[k] for k in ("rid", "doc_id", "n_bytes", "chunk")}
                    | {"n": len(e.ids), "left_at": [name(p, x) for p, _, x in left], "left_n": [n for _, n, _ in left], "right_at": [name(p, x) for p, _, x in right], "right_n": [n for _, n, _ in right]}
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _stable(text: str, spans: list[tuple[int, int]], ids: list[int], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Spaces of text[lo:hi] that no token crosses and that a whole later token follows: (position, tokens before it, the next id)."""
    out, k, n = [], 0, len(spans)
    hi = min(hi, len(text))
    for p in range(lo, hi):
        if text[p] in " \n":
            while k < n and spans[k][0] < p:
                k += 1
            # the last token may be cut by the chunk's end, so it must not be the one that is agreed on
            if k + 1 < n and (k == 0 or spans[k - 1][1] <= p):
                out.append((p, k, ids[k]))
    return out


def _spliced(ends: DataFrame) -> DataFrame:
    """A row per text: n_tokens, null where some neighbours have no common stable position."""
    by = W.partitionBy("rid").orderBy("chunk")
    e = ends.withColumn("next_at", F.lead("left_at").over(by)).withColumn("next_n", F.lead("left_n").over(by)).withColumn("last", F.lead("chunk").over(by).isNull())
    e = e.withColumn("p", F.get(F.array_intersect("right_at", "next_at"), F.lit(0)))
    here = F.when(F.col("last"), F.col("n")).otherwise(F.get("right_n", (F.array_position("right_at", F.col("p")) - 1).cast("int")))
    there = F.when(F.col("last"), F.lit(0)).otherwise(F.get("next_n", (F.array_position("next_at", F.col("p")) - 1).cast("int")))
    e = e.withColumn("part", F.when(F.col("last") | F.col("p").isNotNull(), here - there))
    return e.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, *, chunk_chars: int = 32_768, overlap_chars: int = 512, token_limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; `path` is a file of the tokenizers library."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False)) if encoder(path).by_piece else F.lit(False)
    whole = docs.filter(~long).mapInArrow(_count_whole(path), "doc_id long, n_bytes long, n_tokens long")
    results, step, overlap = [whole], chunk_chars, overlap_chars
    chunks = written(docs.filter(long).mapInArrow(_cut(step, overlap, True), _CHUNKS), "chunks")
    while not chunks.isEmpty():
        # a given number, as the few bytes of a chunk say little about the time that it takes
        ends = chunks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid", "chunk").mapInArrow(_encode_chunks(path, step, overlap), _ENDS)
        done = written(_spliced(ends), "spliced")
        results.append(done.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        failed = done.filter("n_tokens is null").select("rid")
        if failed.isEmpty():
            break
        # the failed texts again, joined from their chunks, in wider ones
        last = W.partitionBy("rid").orderBy("chunk")
        cut = F.when(F.lead("chunk").over(last).isNull(), F.col("text")).otherwise(F.substring("text", 1, step))
        again = chunks.join(failed, "rid", "left_semi").withColumn("text", cut)
        again = again.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
        again = again.select("rid", "doc_id", "n_bytes", F.array_join(F.col("parts.text"), "").alias("text"))
        step, overlap = step * 8, overlap * 8
        chunks = written(again.mapInArrow(_cut(step, overlap, False), _CHUNKS), "chunks")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumn("over_limit", F.col("n_tokens") > token_limit)
