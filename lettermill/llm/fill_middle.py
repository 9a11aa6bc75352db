"""Fill-in-the-middle transformation with a sparse checkpoint index.

A text is a sequence of units: a run of ASCII letters, or one other code point.
Counting the units passes over the text's UTF-8 bytes in blocks of fixed size and
records, for every ``every``-th unit, its byte and its code-point offset.  A cut at
any unit is then found by binary search among these checkpoints and a rescan of
fewer than ``every`` units, so neither counting nor cutting ever holds a list of
units: beside the text itself memory is one block and 16 bytes a checkpoint.

The cuts come from the hash of the id: two of them give the ends of prefix and
middle, one decides whether the text stays plain, one the order of the parts.
:func:`transform` returns the transformed texts, :func:`restore` rebuilds the exact
text from a transformed one and its form; a text that holds a marker stays plain,
so a marker in the output is always one that was put there.

Defined cases: a null text counts as empty and an empty text is plain; a null id
is hashed as an empty number; rows that share an id are cut each by its own text;
repeated rows are transformed each; an empty table gives an empty result; columns
besides id and text are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: A checkpoint every so many units; bytes looked at in one step.
EVERY, BLOCK = 1024, 1 << 20
#: Per cent of the texts that are transformed, and of those that have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def _starts(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For bytes ``low`` to ``high``: which begin a unit, which begin a code point."""
    part = data[max(0, low - 1) : high]
    letter = ((part | 0x20) - np.uint8(97)) < 26
    point = (part & 0xC0) != 0x80
    unit = point & ~letter
    unit[1:] |= letter[1:] & ~letter[:-1]
    if low == 0:
        unit[:1] |= letter[:1]
        return unit, point
    return unit[1:], point[1:]


@dataclass
class Checkpoints:
    """How many units a text has, and where every ``every``-th begins."""

    units: int
    points: int
    every: int
    byte_at: np.ndarray
    point_at: np.ndarray


def count(data: np.ndarray, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
    """Units and code points of UTF-8 bytes, and the checkpoints passed on the way."""
    units, points, at, point_at = 0, 0, [], []
    for low in range(0, len(data), block):
        unit, point = _starts(data, low, low + block)
        where = np.flatnonzero(unit)
        marks = where[-units % every :: every]
        if len(marks):
            at.append(marks + low)
            seen = np.add.reduceat(point, np.r_[0, marks], dtype=np.int64)[:-1] if marks[0] else np.r_[0, np.add.reduceat(point, marks, dtype=np.int64)[:-1]]
            point_at.append(points + np.cumsum(seen))
        units += len(where)
        points += int(np.count_nonzero(point))
    none = np.zeros(0, np.int64)
    return Checkpoints(units, points, every, np.concatenate([none, *at]), np.concatenate([none, *point_at]))


def seek(data: np.ndarray, index: Checkpoints, cut: int, block: int = BLOCK) -> tuple[int, int]:
    """Byte and code-point offset at which unit ``cut`` begins: nearest checkpoint, then a short rescan."""
    if cut >= index.units:
        return len(data), index.points
    mark = int(np.searchsorted(np.arange(len(index.byte_at)) * index.every, cut, "right")) - 1
    low, points, left = int(index.byte_at[mark]), int(index.point_at[mark]), cut - mark * index.every
    step = min(block, 8 * left + 64)
    while True:
        unit, point = _starts(data, low, low + step)
        where = np.flatnonzero(unit)
        if len(where) > left:
            return low + int(where[left]), points + int(np.count_nonzero(point[: where[left]]))
        left, points, low, step = left - len(where), points + int(np.count_nonzero(point)), low + step, min(block, 2 * step)


def draws(id_: int | None) -> list[int]:
    """The four numbers that the id decides."""
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def arrange(id_: int | None, text: bytes, every: int = EVERY, block: int = BLOCK) -> tuple[bytes, str, int, int | None, int | None]:
    """The transformed bytes, their form, the number of units, code points of prefix and of middle."""
    data = np.frombuffer(text, np.uint8)
    index = count(data, every, block)
    first, second, plain, order = draws(id_)
    if not text or plain % 100 >= TRANSFORMED or any(m in text for m in _MARKS):
        return text, "plain", index.units, None, None
    low, high = sorted((first % (index.units + 1), second % (index.units + 1)))
    (a, a_points), (b, b_points) = seek(data, index, low, block), seek(data, index, high, block)
    prefix, middle, suffix = (memoryview(text)[x:y] for x, y in ((0, a), (a, b), (b, len(text))))
    p, s, m = _MARKS
    form = "spm" if order % 100 < SUFFIX_FIRST else "psm"
    parts = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
    return b"".join(parts), form, index.units, a_points, b_points - a_points


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """doc_id, output, form (plain, psm or spm), n (units), prefix_chars and middle_chars (null if plain)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            made = [arrange(i, texts[k].as_buffer().to_pybytes(), every) for k, i in enumerate(ids)]
            output, form, n, prefix, middle = zip(*made, strict=True) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(output, pa.binary()).cast(pa.string()), pa.array(form, pa.string()), *(pa.array(x, pa.int64()) for x in (n, prefix, middle))],
                names=["doc_id", "output", "form", "n", "prefix_chars", "middle_chars"],
            )

    return rows.mapInArrow(bounded(run), "doc_id long, output string, form string, n long, prefix_chars long, middle_chars long")


def restore(output: Column, form: Column) -> Column:
    """The exact text that a transformed one was made from."""
    part = lambda after, until: F.substring_index(F.substring_index(output, after, -1), until, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
