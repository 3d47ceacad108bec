"""Model hooks (V1, T5): a batch function inside Spark tasks.

A hook is a loader and what it loads: a function of a list of texts that gives
a list of results.  The loader runs once in each Python worker process, which
Spark keeps for its later tasks; the loaded function stays there under the hook's
name.  Arrow batches are cut again by bytes, so a batch of long texts does not
outgrow a worker or a device, and one of short texts is not run in crumbs.

Failure policy, as stated by ``on_error``:
    "fail"  an error of the function, or a result list of another length, fails
            the task, and Spark tries it again (default);
    "null"  the texts of the failed call are run one by one, and one that fails
            alone gets null.
A null text gets null and is not handed to the function.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

_LOADED: dict[str, Callable] = {}   # of this worker process


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def cut_by_bytes(texts: list[str], max_bytes: int, max_rows: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``max_bytes`` and ``max_rows``; one text at
    least, however long."""
    part: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode("utf-8", "surrogatepass"))
        if part and (size + n > max_bytes or len(part) >= max_rows):
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


class Hook:
    def __init__(self, load: Callable[[], Callable[[list[str]], list]], name: str | None = None,
                 max_bytes: int = 1 << 20, max_rows: int = 256, on_error: str = "fail"):
        if on_error not in ("fail", "null"):
            raise ValueError(f"on_error is 'fail' or 'null', not {on_error!r}")
        self.load, self.name = load, name or f"hook-{uuid.uuid4().hex}"
        self.max_bytes, self.max_rows, self.on_error = max_bytes, max_rows, on_error

    def call(self, texts: list[str]) -> list:
        run = loaded(self.name, self.load)

        def whole(part: list[str]) -> list:
            got = list(run(part))
            if len(got) != len(part):
                raise ValueError(f"{self.name} gave {len(got)} results for {len(part)} texts")
            return got

        def alone(text: str):
            try:
                return whole([text])[0]
            except Exception:  # noqa: BLE001 - the stated policy
                return None
        out: list = []
        for part in cut_by_bytes(texts, self.max_bytes, self.max_rows):
            try:
                out += whole(part)
            except Exception:
                if self.on_error == "fail":
                    raise
                out += [alone(t) for t in part]
        return out

    def apply(self, df: DataFrame, text_col: str, result: str) -> DataFrame:
        """``df`` with one more column ``result`` ("name type")."""
        field = _parse_datatype_string(result).fields[0]
        kind = to_arrow_type(field.dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(text_col).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None]
                out: list = [None] * len(texts)
                for i, v in zip(some, self.call([texts[i] for i in some])):
                    out[i] = v
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, field.name])
        return df.mapInArrow(run, StructType([*df.schema.fields, field]))
