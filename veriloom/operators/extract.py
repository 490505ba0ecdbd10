"""Hooks for an extractor and for rules of one's own."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Extractor = Callable[[pd.Series], pd.Series]


def with_extractor(requests: DataFrame, extract: Extractor) -> DataFrame:
    """(doc_id, chunk_no, raw): the answers of ``extract``, which gets the texts of a batch of
    requests (doc_id, chunk_no, text); the only place where executors leave the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "chunk_no": batch["chunk_no"], "raw": extract(batch["text"])})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select("doc_id", "chunk_no").schema)
    return requests.select("doc_id", "chunk_no", "text").mapInPandas(run, f"{kinds}, raw string")


def stub(texts: pd.Series) -> pd.Series:
    """A deterministic extractor for tests: a record with the text's length as its amount."""
    record = '{"document":{"fileName":"a.pdf","pages":1,"language":"en","type":"raport","title":null,"date":null},"summary":"One. Two. Three.","keyPoints":["a","b","c"],"amounts":[{"value":"%d","currency":"EUR","context":"length"}],"dates":[],"keywords":[]}'
    return texts.str.len().map(lambda n: record % n)
