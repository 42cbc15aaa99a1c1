"""Ranked full-text search over a persisted index (see index.py)."""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import FIELDS, SearchIndex, bucket, near_terms, variants
from .manifest import shared_dir

K1, B = 1.2, 0.75
#: Expansions of a fuzzy word and of a phrase's last word, and what an expansion but the best adds.
MOST_EXPANSIONS, TIE = 50, 0.01
#: Boosts of the clauses: all terms in one field, a phrase whose last word is a prefix, any term in the address.
ALL_TERMS, PHRASE, ADDRESS = {"title": 10.0, "snippet": 3.0, "body": 1.0}, {"title": 12.0, "snippet": 3.0}, 0.5


@dataclass(frozen=True)
class SearchParams:
    q: str
    limit: int = 10
    offset: int = 0
    lang: str | None = None
    site: str | None = None
    network: str | None = None
    freshness_days: int | None = None

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\W_]+", self.q.lower())

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(self.words))


def postings(docs: DataFrame, terms: list[str] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, term, id, tf, dl). With `terms` others are dropped before anything is shuffled."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.tokens(F.col(f)).alias("tokens")) for f in fields]))
    split = docs.select("id", rows.alias("x")).select("id", "x.field", F.size("x.tokens").cast("long").alias("dl"), F.explode("x.tokens").alias("term"))
    if terms is not None:
        split = split.where(F.col("term").isin(*terms))
    return split.groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"))


def field_stats(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, n, avgdl) over documents that have the field: a row a field."""
    sizes = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tx.tokens(F.col(f))).cast("long").alias("dl")) for f in fields]))
    return docs.select(sizes.alias("x")).where("x.dl > 0").groupBy("x.field").agg(F.count("*").alias("n"), F.avg("x.dl").alias("avgdl"))


def indexed(source: DataFrame | SearchIndex) -> SearchIndex:
    """An index as it is; of documents, a new one in the shared folder."""
    if isinstance(source, SearchIndex):
        return source
    index = SearchIndex(source.sparkSession, f"{shared_dir(source.sparkSession)}/index-{uuid.uuid4().hex}", buckets=8)
    index.rebuild(source)
    return index


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, dl: Column, field: Column, index: SearchIndex) -> Column:
    """BM25's weight of a frequency in a field of dl words."""
    lengths = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, index.stats().get(f, (0, 1.0))[1])])
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.try_element_at(lengths, field)))


def expansions(index: SearchIndex, terms: list[str], most: int = MOST_EXPANSIONS) -> list:
    """(field, query_term, term, distance, df) of each field's words near a query word: `most` at most of a field and word, the nearest
    first, then the most frequent. They come from the buckets of the words' variants."""
    spark, sides = index.spark, [(t, v) for t in terms for v in variants(t, allowed_edits(t))]
    near = index.of_terms("neighbours", [v for _, v in sides], "variant").select("variant", "term")
    near = near.join(F.broadcast(spark.createDataFrame(sides, "query_term string, variant string")), "variant")  # 16 variants a word at most
    close = within(near.select("query_term", "term").distinct()).withColumn("bucket", bucket(F.col("term"), index.buckets))
    counts = index.table("counts").join(close, ["bucket", "term"]).groupBy("field", "query_term", "term", "distance").agg(F.sum("n").alias("df")).where("df > 0")
    order = Window.partitionBy("field", "query_term").orderBy("distance", F.col("df").desc(), "term")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r").collect()  # `most` rows of a field and word


def all_terms(index: SearchIndex, terms: list[str]) -> DataFrame:
    """Documents with every query word, or one near it, in one field; the best field counts. A word scores its best expansion and a
    hundredth of the others; an expansion weighs less by its edits, as a share of the shorter of the two words, and all of a word's
    expansions in a field are taken to be as frequent as the most frequent one."""
    found, stats, largest = [r for r in expansions(index, terms) if r.field in ALL_TERMS], index.stats(), defaultdict(int)
    for r in found:
        largest[r.field, r.query_term] = max(largest[r.field, r.query_term], r.df)
    rows = [(r.field, r.query_term, r.term, (1 - r.distance / min(len(r.query_term), len(r.term))) * idf(stats[r.field][0], largest[r.field, r.query_term])) for r in found]
    weights = F.broadcast(index.spark.createDataFrame(rows, "field string, query_term string, term string, weight double"))  # 50 for each word and field
    scored = index.postings({r.term for r in found}).join(weights, ["field", "term"])
    scored = scored.withColumn("score", F.col("weight") * saturated(F.col("tf"), F.col("dl"), F.col("field"), index))
    words = scored.groupBy("id", "field", "query_term").agg(((1 - TIE) * F.max("score") + TIE * F.sum("score")).alias("s"))
    boost = F.create_map(*[F.lit(x) for kv in ALL_TERMS.items() for x in kv])
    fields = words.groupBy("id", "field").agg(F.count("*").alias("k"), F.sum("s").alias("s")).where(F.col("k") == len(terms))
    return fields.groupBy("id").agg(F.max(F.col("s") * boost[F.col("field")]).alias("score"))


def any_in_address(index: SearchIndex, terms: list[str]) -> DataFrame:
    """Documents with any query word in their address."""
    n = index.stats().get("display_url", (0, 1.0))[0]
    known = index.frequencies(index.of_terms("counts", terms).where("field = 'display_url'")).collect()  # a row a word
    weights = F.broadcast(index.spark.createDataFrame([(r.term, idf(n, r.df)) for r in known], "term string, weight double"))
    scored = index.postings(terms).where("field = 'display_url'").join(weights, "term")
    return scored.groupBy("id").agg((ADDRESS * F.sum(F.col("weight") * saturated(F.col("tf"), F.col("dl"), F.col("field"), index))).alias("score"))


def prefix_terms(index: SearchIndex, prefix: str, fields: tuple[str, ...], most: int = MOST_EXPANSIONS) -> list:
    """(field, term, df): the first words of each field, in order, that begin so."""
    begun = index.table("counts").where(F.col("term").startswith(prefix) & F.col("field").isin(*fields))
    order = Window.partitionBy("field").orderBy("term")
    return index.frequencies(begun).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r").collect()  # `most` rows a field


def phrase_prefix(index: SearchIndex, words: list[str]) -> DataFrame:
    """Documents in which the words follow each other in a field, the last one as a prefix. A field's score is BM25 with the number of
    such places as the frequency and the sum of all words' and expansions' idf; the best field counts."""
    fields, exact, stats = tuple(PHRASE), words[:-1], index.stats()
    last = prefix_terms(index, words[-1], fields)
    df = {(r.field, r.term): r.df for r in index.frequencies(index.of_terms("counts", exact).where(F.col("field").isin(*fields))).collect()} if exact else {}  # a row a word and field
    ends = {f: [r.term for r in last if r.field == f] for f in fields}
    # fields that lack one of the words hold no such phrase
    weight = {f: PHRASE[f] * (sum(idf(stats[f][0], df[f, w]) for w in exact) + sum(idf(stats[f][0], r.df) for r in last if r.field == f)) for f in fields if ends[f] and all((f, w) in df for w in exact)}
    posts = index.postings([*exact, *[t for f in weight for t in ends[f]]]).where(F.col("field").isin(*weight))
    moved = lambda i: F.transform("positions", lambda p: p - i)
    is_end = reduce(lambda x, y: x | y, [(F.col("field") == f) & F.col("term").isin(ends[f]) for f in weight], F.lit(False))
    places = [F.first(F.when(F.col("term") == w, moved(i)), ignorenulls=True) for i, w in enumerate(exact)]
    places.append(F.flatten(F.collect_list(F.when(is_end, moved(len(exact))))))
    met = posts.groupBy("id", "field", "dl").agg(*[c.alias(f"p{i}") for i, c in enumerate(places)])
    tf = F.size(reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(places))])).cast("long")
    weights = F.create_map(*[F.lit(x) for kv in (weight or {"": 0.0}).items() for x in kv])
    scored = met.withColumn("tf", tf).where("tf > 0").withColumn("score", F.try_element_at(weights, F.col("field")) * saturated(F.col("tf"), F.col("dl"), F.col("field"), index))
    return scored.groupBy("id").agg(F.max("score").alias("score"))


def filters(p: SearchParams, now: Column) -> Column:
    out = F.lit(True)
    if p.lang and p.lang.strip():
        out = out & (F.col("language") == p.lang.strip().lower())
    if p.freshness_days:
        out = out & (F.col("fetched_at") >= now - F.make_dt_interval(F.lit(p.freshness_days)))
    if p.network in ("clearnet", "tor"):
        out = out & (F.col("network") == p.network)
    if p.site and p.site.strip():
        out = out & site_filter(p.site)
    return out


def site_filter(site: str) -> Column:
    """The host, one below it, or an address that contains the site; * and ? are wild."""
    s = site.strip().lower()
    for scheme in ("https://", "http://"):
        if s.startswith(scheme):
            s = s.removeprefix(scheme)
            break
    s = s.strip("/")
    like = s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return (F.col("host") == s) | F.col("host").like("%." + like) | F.col("canonical_url").like(f"%{like}%")


def decay(fetched: Column, now: Column) -> Column:
    """1 for a week, then falling to 0.3 after 60 days more."""
    days = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched.cast("timestamp"))) / 86_400_000_000
    return F.exp(F.ln(F.lit(0.3)) / 60.0 * F.greatest(F.lit(0.0), days - 7.0))


def scored_documents(source: DataFrame | SearchIndex, p: SearchParams, now: Column, clauses: tuple[str, ...] = ("all", "phrase", "address")) -> DataFrame:
    """(id, score) of every document that a clause and all filters admit: clause scores add up, authority and age multiply."""
    index = indexed(source)
    docs = index.documents()
    parts = {"all": lambda: all_terms(index, p.terms), "phrase": lambda: phrase_prefix(index, p.words), "address": lambda: any_in_address(index, p.terms)}
    union = None
    for c in clauses:
        union = parts[c]() if union is None else union.unionByName(parts[c]())
    total = union.groupBy("id").agg(F.sum("score").alias("text_score"))
    admitted = docs.where(filters(p, now)).select("id", "fetched_at", "site_authority")
    rank = F.col("text_score") * 2.0 * F.coalesce(F.col("site_authority"), F.lit(0.5)) * decay(F.col("fetched_at"), now)
    return total.join(admitted, "id").select("id", "fetched_at", rank.alias("score"))


def search(source: DataFrame | SearchIndex, p: SearchParams, now: Column, clauses: tuple[str, ...] = ("all", "phrase", "address")) -> DataFrame:
    """One page of results, best first; only its rows are joined with what is shown of them."""
    if not p.terms:
        raise ValueError("the query has no word")
    index = indexed(source)
    docs = index.documents()
    top = scored_documents(index, p, now, clauses).orderBy(F.round("score", 6).desc(), F.col("fetched_at").desc(), "id").offset(max(0, p.offset)).limit(max(0, min(20, p.limit)))
    shown = docs.select("id", "canonical_url", "display_url", "title", "snippet", "language")
    return F.broadcast(top).join(shown, "id")  # a page of 20 rows at most


#: Fixed value: how deep a page may lie.
MOST_RESULTS = 10_000


def respond(source: DataFrame | SearchIndex, p: SearchParams, now: Column) -> dict:
    """A page as a plain mapping: results (20 at most), the total, and the offset of the next page, null on the last. A query
    without a word and a page beyond MOST_RESULTS find nothing. Errors are raised, not turned into empty pages."""
    spark = source.spark if isinstance(source, SearchIndex) else source.sparkSession
    corrected = spark.range(1).select(tx.correct_spelling(F.lit(p.q))).first()[0]
    if not p.terms or p.offset + p.limit > MOST_RESULTS:
        return {"query": p.q, "results": [], "total": 0, "next_offset": None, "did_you_mean": corrected}
    index = indexed(source)
    total = scored_documents(index, p, now).count()
    rows = [r.asDict() | {"score": r["score"] or 0.0} for r in search(index, p, now).orderBy(F.col("score").desc(), F.col("fetched_at").desc(), "id").collect()]  # 20 at most
    after = max(0, p.offset) + len(rows)
    return {"query": p.q, "results": rows, "total": total, "next_offset": after if after < total else None, "did_you_mean": corrected}


def allowed_edits(term: str) -> int:
    """None up to two letters, one up to five, two beyond."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def within(near: DataFrame) -> DataFrame:
    """(query_term, term) with the distance, where it is no more than the query word allows; a swap of neighbours is one edit."""

    @F.pandas_udf("int")
    def osa(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y) for x, y in zip(a, b)], dtype="int32")

    allowed = F.when(F.length("query_term") <= 2, 0).when(F.length("query_term") <= 5, 1).otherwise(2)
    plain = F.levenshtein("query_term", "term", 4)  # a swap is two edits there, so no more than twice as many; -1 beyond 4
    maybe = near.where((F.abs(F.length("term") - F.length("query_term")) <= allowed) & plain.between(0, 2 * allowed))
    return maybe.withColumn("distance", osa("query_term", "term")).where(F.col("distance") <= allowed)


def fuzzy_terms(vocabulary: DataFrame, terms: list[str] | DataFrame, most: int = MOST_EXPANSIONS) -> DataFrame:
    """(query_term, term, distance): words of a vocabulary within 0, 1 or 2 edits by the query word's length, `most` of each. terms: a
    list, or any number of them as a column query_term; they meet the vocabulary by equal variants."""
    words = terms if isinstance(terms, DataFrame) else vocabulary.sparkSession.createDataFrame([(t,) for t in terms], "query_term string")
    order = Window.partitionBy("query_term").orderBy("distance", "term")
    return within(near_terms(vocabulary, words)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def edits(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def suggest(inputs: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Distinct completions of the query in order."""
    q = query.strip().lower()
    return inputs.select(F.explode("suggest_input").alias("suggestion")).where(F.col("suggestion").startswith(q)).distinct().orderBy("suggestion").limit(limit)


def cache_key(p: SearchParams) -> str | None:
    """Only the unfiltered first page is kept."""
    plain = not (p.offset or p.lang or p.site or p.network or p.freshness_days)
    return f"search:{p.q.strip().lower()}:{min(20, p.limit)}" if plain else None
