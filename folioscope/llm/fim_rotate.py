"""Fill-in-the-middle: a text cut into prefix, middle and suffix, its blocks
exchanged in place.

A text lies in one bytearray. The cuts are drawn in code points and found in
the bytes by a scan; sentinels are inserted at the cuts, which gives
``<P>prefix<M>middle<S>suffix``; then two neighbouring blocks are exchanged by
three reversals (each block, then both together). ``psm`` exchanges middle and
suffix, ``spm`` brings the suffix to the front. Restoring finds the sentinels,
exchanges the blocks back by the same reversals and deletes the sentinels.

Both passes are narrow: no shuffle, a worker holds one slice of texts and
blocks of ``BLOCK`` bytes besides. The draws depend on the id alone, so a
repeated task gives the same rows.

Null texts count as empty; empty texts and texts that hold a sentinel stay
plain. A null id counts as the empty string. Repeated rows are treated alike;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices

#: Sentinels before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those from this number on stay plain; of the others those below ``SPM`` bring the suffix first.
PLAIN_FROM, SPM = 90, 20
#: Bytes that a scan or a reversal looks at together.
BLOCK = 1 << 16


def draws(row_id, seed: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id: the first digits of the SHA-256 of ``seed:id``."""
    text = f"{seed}:{'' if row_id is None else row_id}"
    return struct.unpack(">4I", hashlib.sha256(text.encode()).digest()[:16])


def byte_offset(data: bytes | bytearray, point: int, start: int = 0) -> int:
    """Where, counted from ``start``, the ``point``-th code point begins: a
    scan for bytes that begin one, block by block."""
    for at in range(start, len(data), BLOCK):
        begins = (np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at) & 0xC0) != 0x80
        n = int(np.count_nonzero(begins))
        if point < n:
            return at + int(np.flatnonzero(begins)[point])
        point -= n
    return len(data)


def reverse(buf: bytearray, i: int, j: int) -> None:
    """``buf[i:j]`` reversed in place, a block from either end at a time."""
    while j - i > 1:
        n = min(BLOCK, (j - i + 1) // 2)
        head, tail = buf[i:i + n], buf[j - n:j]
        buf[i:i + n], buf[j - n:j] = tail[::-1], head[::-1]
        i, j = i + n, j - n


def rotate(buf: bytearray, i: int, m: int, j: int) -> None:
    """The blocks ``buf[i:m]`` and ``buf[m:j]`` exchanged by three reversals."""
    reverse(buf, i, m)
    reverse(buf, m, j)
    reverse(buf, i, j)


def blocks(buf: bytearray, first: int, second: int, form: str, marks: tuple[bytes, ...]) -> None:
    """Sentinels at the byte offsets of the cuts, and the blocks in the order of ``form``."""
    p, s, m = marks
    buf[second:second] = s
    buf[first:first] = m
    buf[0:0] = p
    middle = len(p) + first
    suffix = middle + len(m) + second - first
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))


def unblocks(buf: bytearray, form: str, marks: tuple[bytes, ...]) -> None:
    """The inverse of ``blocks``: the text alone."""
    p, s, m = marks
    if form == "psm":
        rotate(buf, buf.index(s), buf.index(m), len(buf))
    else:
        rotate(buf, 0, buf.index(p), len(buf))
    for mark in (s, m, p):
        at = buf.index(mark)
        del buf[at:at + len(mark)]


def transform(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1,
              marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm: int = SPM) -> DataFrame:
    """``id_column``, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output`` of every row."""
    signs = tuple(x.encode() for x in marks)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(part.column(1), "")
        sizes = pc.utf8_length(texts).to_pylist()
        rows = []
        for row_id, text, n in zip(part.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), sizes):
            h1, h2, h3, h4 = draws(row_id, seed)
            if not text or h3 % 100 >= plain_from or any(x in text for x in signs):
                rows.append(("plain", None, None, text))
                continue
            form = "spm" if h4 % 100 < spm else "psm"
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            buf = bytearray(text)
            if len(buf) == n:
                cut, end = first, second
            else:
                cut = byte_offset(text, first)
                end = byte_offset(text, second - first, cut)
            blocks(buf, cut, end, form, signs)
            rows.append((form, first, second - first, bytes(buf)))
        forms, prefixes, middles, outputs = zip(*rows)
        return pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                                pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                               names=[id_column, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = df.select(F.col(id_column), F.col(text_column))
    kind = rows.schema[0].dataType.simpleString()
    return map_slices(rows, work, f"`{id_column}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string", 1)


def restore(df: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form``."""
    signs = tuple(x.encode() for x in marks)
    names = df.columns
    form_at, output_at = names.index("form"), names.index("output")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for form, text in zip(part.column(form_at).to_pylist(), part.column(output_at).cast(pa.binary()).to_pylist()):
            if form != "plain":
                buf = bytearray(text)
                unblocks(buf, form, signs)
                text = bytes(buf)
            out.append(text)
        return pa.record_batch([*part.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_slices(df, work, f"{schema}, restored string", output_at)
