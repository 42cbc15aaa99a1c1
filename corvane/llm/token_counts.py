"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pre-tokens, then each worker's own cache."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_columns, slices

#: The mark that stands for a space in the vocabulary; in a text it means the same as a space.
MARK = "▁"
RUNS = re.compile(" *[^ ]+| +").findall


def pre_tokens(text: str) -> list[str]:
    """Parts of a text, whose token counts add up to the text's: no piece of the vocabulary has a space after another
    character, so no merge crosses the place before a run of spaces. The first space of each part is left out,
    as the library puts one before what it encodes."""
    if not text:
        return []
    text = text.replace(MARK, " ") if MARK in text else text
    parts = text.split(" ")
    return [p[1:] for p in RUNS(" " + text)] if "" in parts else parts


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(p.get_piece_size()):
        if not p.is_control(i) and re.search(f"[^{MARK}]{MARK}", p.id_to_piece(i)):
            raise ValueError(f"{path}: a piece holds a space inside, so texts can't be cut at spaces")
    return p


#: Second tier, by vocabulary: lengths of parts that the broadcast table lacks, kept as long as the Python worker lives.
CACHE: dict[str, dict[str, int]] = {}


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int, table_parts: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about `sample_docs` documents of 64 KB at most, chosen by a hash.
    It only saves time: what the table lacks is encoded."""
    n = docs.count()
    counts: Counter[str] = Counter()
    for row in bounded_sample(docs.where(F.octet_length("text") <= 1 << 16), sample_docs / max(1, n), 2 * sample_docs, 2):
        counts.update(pre_tokens(row["text"]))
    words = [w for w, _ in counts.most_common(table_parts)]
    return dict(zip(words, map(len, processor(path).encode(words, num_threads=1))))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, sample_docs: int = 2000, table_parts: int = 30_000, cache_parts: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the sentencepiece model at `path` counts them.

    No pre-token is shuffled. The broadcast table has `table_parts` entries at most, a worker's cache `cache_parts` (then
    it starts anew). Null text: empty, 0 tokens. Null and repeated doc_ids: a row each. Empty table: no rows. Other
    columns are ignored.
    """
    docs = doc_columns(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, table_parts))

    def run(batches):
        encode, frequent = processor(path).encode, table.value
        for b in batches:
            counts: list[int] = []
            for _, _, texts in slices(b):
                parts = [pre_tokens(t) for t in texts]
                cache = CACHE.setdefault(path, {})
                if len(cache) > cache_parts + len(frequent):
                    cache.clear()
                if not cache:
                    cache.update(frequent)
                    cache[""] = 1  # a lone space: the mark itself
                new = list(set().union(*parts).difference(cache))
                cache.update(zip(new, map(len, encode(new, num_threads=1))))
                get = cache.__getitem__
                counts += [sum(map(get, p)) for p in parts]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
