"""Media columns: content-addressed payloads in tar shards, described by rows of digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: A payload is padded with spaces to a positive multiple of this many bytes.
UNIT = 192
#: Samples of a row of the stored image: one unit.
WIDTH = UNIT
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the whole first chunk, which holds the size and the kind of samples.
HEADER_BYTES = 33
#: Bytes of a data chunk at most; the format allows 2**31 - 1.
MOST = 1 << 30


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(samples: bytes) -> bytes:
    """The samples as a grey PNG image, 8 bits each, one unit a row; lossless and compressed."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    plain = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1).tobytes()  # filter 0 before each row
    packed = zlib.compress(plain, 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + b"".join(chunk(b"IDAT", packed[k : k + MOST]) for k in range(0, len(packed), MOST)) + chunk(b"IEND", b"")


def header_of(raw: bytes) -> dict:
    signature, _, kind, width, height, bits, colour = struct.unpack(">8sI4sIIBB", raw[:26])
    if (signature, kind, bits, colour) != (SIGNATURE, b"IHDR", 8, 0):
        raise ValueError("not a grey PNG image of 8 bits")
    return {"width": width, "height": height, "bits": bits}


def samples_of(media: bytes) -> bytes:
    """The samples of an image that `png_of` made."""
    parts, at = [], HEADER_BYTES
    while media[at + 4 : at + 8] == b"IDAT":
        (length,) = struct.unpack(">I", media[at : at + 4])
        parts.append(media[at + 8 : at + 8 + length])
        at += length + 12
    plain = zlib.decompress(b"".join(parts))
    return np.frombuffer(plain, dtype=np.uint8).reshape(-1, header_of(media)["width"] + 1)[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean, deviation, range and level crossings of the samples, then the shares of eight amplitude bands in per mille."""
    x = np.frombuffer(samples, dtype=np.uint8)
    m, n = int(x.sum(dtype=np.int64)), len(x)
    v = int((x.astype(np.int64) ** 2).sum()) * n - m * m
    up = x.astype(np.int64) * n > m
    bands = np.bincount(x >> 5, minlength=8) * 1000 // n
    return f"mean={m * 1000 // n};var={v * 1000 // (n * n)};min={x.min()};max={x.max()};cross={int((up[1:] != up[:-1]).sum())};bands={','.join(map(str, bands))}"


#: Fields of a stored payload, beside the row's own id.
STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int"


def store(docs: DataFrame, folder: str, *, id: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Store each text as an 8-bit grey PNG image in tar shards under `folder`; return one row per document.

    Each task writes the texts it reads into shards of about `shard_bytes`, each payload once per shard under
    its SHA-256, and closes a shard before it reads back: headers by range reads of 33 bytes at the recorded
    offsets, then the samples. A shard is named by the digests it holds, written under a new name and then renamed; one that is there
    already is not written again. So a repeated, speculative or lost task, or a second action on the result, ends with the same shards and the same rows,
    as long as the input is read in the same partitions; a task that dies leaves at most a file whose name begins with a dot. Equal texts give equal values in all columns but shard and offset. A null or empty text is stored
    as one unit of spaces; repeated rows and null ids each get their row; an empty table writes no shard. `folder` is any location that pyarrow's file systems open; all tasks and
    readers must share it.
    """
    fields = "id long, " + STORED
    # A generator per partition: at most one shard's worth of payloads is held at a time.

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)

        def shard(rows):
            name = f"{base}/{hashlib.sha256(''.join(dict.fromkeys(digest for *_, digest in rows)).encode()).hexdigest()}.tar"
            new = f"{base}/.{uuid.uuid4().hex}"
            places: dict[str, tuple[int, int]] = {}
            with fs.open_output_stream(new) as out:
                at = 0
                for _, _, payload, digest in rows:
                    if digest in places:
                        continue
                    media = png_of(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    pad = -len(media) % tarfile.BLOCKSIZE
                    out.write(head + media + b"\0" * pad)
                    places[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + pad
                out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                fs.move(new, name)
            else:
                fs.delete_file(new)
            found: dict[str, dict] = {}
            with fs.open_input_file(name) as f:
                for digest, (offset, length) in places.items():
                    head = header_of(f.read_at(HEADER_BYTES, offset))
                    media = f.read_at(length, offset)
                    samples = samples_of(media)
                    found[digest] = {
                        "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(samples),
                        "shard": name, "offset": offset, "width": head["width"], "height": head["height"],
                    }
            return pa.RecordBatch.from_pylist([{"id": i, "n_bytes": n} | found[digest] for i, n, _, digest in rows], schema=schema)

        rows, size = [], 0
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for k in range(batch.num_rows):
                t = texts[k].as_py()
                payload = payload_of(t)
                rows.append((ids[k].as_py(), len(payload) if t is None else len(t.encode()), payload, hashlib.sha256(payload).hexdigest()))
                if t is None:
                    rows[-1] = (rows[-1][0], 0, *rows[-1][2:])
                size += len(payload)
                if size >= shard_bytes:
                    yield shard(rows)
                    rows, size = [], 0
        if rows:
            yield shard(rows)

    schema = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (f.split() for f in fields.split(", "))])
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(write, fields).withColumnRenamed("id", id)


def read_member(shard: str, offset: int, length: int) -> bytes:
    """The bytes of one stored payload."""
    fs, path = pafs.FileSystem.from_uri(shard) if "://" in shard else (pafs.LocalFileSystem(), shard)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def op7_media(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, shard_bytes=16 << 20)
