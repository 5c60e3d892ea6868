"""Entities that come from a model: any function over texts as a detector beside the built-in recognisers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.functions import pii

#: (type, start, end, confidence) of the entities of one text; a confidence of None is `DEFAULT`.
Found = Sequence[tuple[str, int, int, float | None]]
DEFAULT = 0.7
#: What common models call their entities, and the types here.
LABELS = {
    "PER": "PERSON", "PERSON": "PERSON", "person": "PERSON",
    "ORG": "ORGANISATION", "ORGANIZATION": "ORGANISATION", "organisation": "ORGANISATION", "organization": "ORGANISATION",
    "LOC": "LOCATION", "GPE": "LOCATION", "LOCATION": "LOCATION", "location": "LOCATION",
    "DATE": "DATE", "DATE_TIME": "DATE", "date": "DATE",
    "MONEY": "MONEY", "money": "MONEY",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IBAN_CODE": "DE_IBAN",
}
_ROW = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("confidence", T.DoubleType()), ("source", T.StringType()), ("recognizer", T.StringType()))])
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string()), ("recognizer", pa.string())]))


def named_entities(load: Callable[[], Callable[[str], Found]], source: str, name: str | None = None) -> pii.Detector:
    """A detector from `load`, which a worker calls once to get its function from a text to its entities.

    source is one of `pii.PRIORITY`, which settles overlaps. Labels are translated by LABELS; those that
    it does not know are dropped, as are spans outside the text. Null texts have none.
    """
    if source not in pii.PRIORITY:
        raise ValueError(f"unknown source {source!r}; one of {', '.join(pii.PRIORITY)}")
    loaded: list[Callable[[str], Found]] = []

    @F.arrow_udf(T.ArrayType(_ROW))
    def run(x: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load())

        def rows(text: str | None) -> list[dict]:
            found = loaded[0](text) if text else ()
            known = set(LABELS.values())
            return [
                {"type": LABELS.get(label, label), "text": text[a:b], "start": a, "end": b, "confidence": DEFAULT if sure is None else sure, "source": source, "recognizer": name or source}
                for label, a, b, sure in found
                if (label in LABELS or label in known) and 0 <= a < b <= len(text)
            ]

        return pa.array([rows(t) for t in x.to_pylist()], _ARROW)

    return lambda text: run(text)
