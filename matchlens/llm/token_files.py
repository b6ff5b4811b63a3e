"""Token ids as flat unsigned-integer files with 64-bit document offsets.

A part is three files: the ids (16 bits each if the vocabulary allows, else 32,
little-endian), the offsets of its documents (unsigned 64-bit, one more than
documents, from 0) and the document ids (signed 64-bit). Parts are ranges of
doc_id, so the parts in order are the documents in order; a part's base, the ids
before it, is a prefix sum over the parts' totals. Readers map the files into
memory. A part is written under a name of its own and then renamed, so a task
that runs twice does no harm.

Files are written with pyarrow's file systems: the folder is a path or URI that
the executors share.

Edge cases: null and empty text is the end id alone. Repeated ids stay, ordered
by text; texts of one id that begin with the same 64 characters go to one part. A null doc_id comes first and is stored as the least 64-bit integer. An
empty table gives no parts. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import new_path, stage
from .common import bounded_batches, tidy, tokenizer_path
from .tokens import encoder

END_ID = 2
PART_BYTES = 24 << 20
#: Parts at most; beyond that many, parts are larger.
MAX_PARTS = 20_000
NO_ID = np.iinfo(np.int64).min


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all parts; returns the manifest (part, name, width, n_docs, n_tokens, base), a row for each part."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(-(-size // part_bytes), MAX_PARTS))
    # the beginning of the text lets rows that share an id, as nulls do, go to several parts
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def mapped(batches):
        enc, fs, part = encoder(path), None, TaskContext.get().partitionId()
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        offsets, docs_seen, first, at = [np.zeros(1, dtype="<u8")], [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if fs is None:
                fs, root = _fs(folder)
                fs.create_dir(root, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{root}/_{name}.ids")
                first = b.column("doc_id")[0].as_py()
            blobs = enc.encode_all(b.column("text").to_pylist())
            out.write(np.frombuffer(end.join([*blobs, b""]), dtype="<u4").astype(f"<u{width}").tobytes())
            ends = at + np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4 + 1)
            offsets.append(ends.astype("<u8"))
            at = int(ends[-1])
            docs_seen.append(b.column("doc_id").fill_null(int(NO_ID)).to_numpy().astype("<i8"))
        if fs is None:
            return
        out.close()
        for kind, data in (("offsets", np.concatenate(offsets)), ("docs", np.concatenate(docs_seen))):
            with fs.open_output_stream(f"{root}/_{name}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("ids", "offsets", "docs"):
            fs.move(f"{root}/_{name}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([name]), pa.array([width], pa.int32()), pa.array([first], pa.int64()),
            pa.array([sum(map(len, docs_seen))], pa.int64()), pa.array([at], pa.int64()),
        ], ["part", "name", "width", "first_id", "n_docs", "n_tokens"])

    files = stage(ordered.mapInArrow(tidy(mapped), "part int, name string, width int, first_id long, n_docs long, n_tokens long"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, 20,000 at most
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def read(manifest: DataFrame, folder: str, batch: int = 4096) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files."""
    spread = manifest.select("part", "name", "width", "base").repartition(max(1, manifest.count()), "part")

    def mapped(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, root = _fs(folder)
                offsets = _mapped(fs, f"{root}/{r['name']}.offsets", "<u8").astype(np.int64)
                doc_ids = _mapped(fs, f"{root}/{r['name']}.docs", "<i8")
                ids = _mapped(fs, f"{root}/{r['name']}.ids", f"<u{r['width']}")
                for i in range(0, len(doc_ids), batch):
                    cut = doc_ids[i:i + batch]
                    n = len(cut)
                    crc = [zlib.crc32(ids[offsets[j]:offsets[j + 1]].astype("<u4").tobytes()) for j in range(i, i + n)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(cut), mask=np.asarray(cut) == NO_ID), pa.array(offsets[i:i + n] + r["base"]),
                        pa.array(offsets[i + 1:i + n + 1] - offsets[i:i + n]), pa.array(crc, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(tidy(mapped), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write `docs` under the shared folder and read the files back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id), folder)
