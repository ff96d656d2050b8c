"""Language of web pages by Bayesian fusion of evidence.

Posterior of a language = likelihood of the page's text x likelihood of the language its markup declares x likelihood of the
address suffix x prior of its host. The last three are estimated by grouped aggregation of the text's posteriors over all
pages; a host's prior is smoothed towards its domain's, that towards all pages'. Hosts are summed map-side first, so a host
with a third of all pages costs one row per task; what is joined back is one row a host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsql.llm.text import Cache, cut, ready, slices, tidied

BITS = 17
#: Bound of the sample of documents with a language that the text model is fitted on.
SAMPLE_ROWS = 2000
#: The words of a text are not independent; all of them together count as so many features at most.
EVIDENCE = 40
#: Pages that the level above counts as: of a host's domain, of all pages.
STRENGTH = 5.0

#: Elements whose text is not shown.
UNSHOWN = ("script", "style", "nav")
OPENED = re.compile(rf"<!--|<({'|'.join(UNSHOWN)})\b", re.IGNORECASE)
CLOSED = {"": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in UNSHOWN}
ROOT = re.compile(r"<html\b[^>]*", re.IGNORECASE)
DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")


class Marks(Cache):
    """word -> feature numbers: the word, its beginning and its end."""

    def make(self, word: str) -> tuple[int, ...]:
        return tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - BITS) for w in (word, "^" + word[:3], word[-3:] + "$"))


MARKS = Marks()


def features(text: str) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(MARKS.__getitem__, WORD.findall(text.lower()))), np.int64)


def shown(page: str) -> Iterator[str]:
    """The parts of a page between comments and elements that are not shown. One that is not closed hides nothing.

    Each close is looked for once from where it can stand, so a page takes time in proportion to its length.
    """
    at, search, ends = 0, 0, dict.fromkeys(CLOSED, 0)
    while m := OPENED.search(page, search):
        kind = (m[1] or "").lower()
        if ends[kind] is not None and ends[kind] < m.end():
            close = CLOSED[kind].search(page, m.end())
            ends[kind] = close.start() if close else None
        if ends[kind] is None:
            search = m.end()
            continue
        yield page[at : m.start()]
        at = search = CLOSED[kind].match(page, ends[kind]).end()
    yield page[at:]


def without_tags(part: str) -> Iterator[str]:
    """What is left of a part without its tags; an angle bracket that no other closes is text."""
    at, last = 0, part.rfind(">")
    while (i := part.find("<", at)) >= 0 and i < last:
        yield part[at:i]
        at = part.find(">", i) + 1
    yield part[at:]


def visible(page: str) -> str:
    return entities.unescape(" ".join(" ".join(without_tags(part)) for part in shown(page)))


def declared(page: str) -> str:
    """Two letters of the first language that an html tag of the page declares, or none."""
    for tag in ROOT.finditer(page):
        if m := DECLARED.search(tag[0]):
            return m[1][:2].lower()
    return ""


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each feature (rows) in each language (columns), smoothed."""
    langs = sorted({lang for _, lang in rows})
    counts = np.full((1 << BITS, max(1, len(langs))), 0.1)
    for text, lang in rows:
        counts[:, langs.index(lang)] += np.bincount(features(text), minlength=1 << BITS)
    return langs, np.log(counts / counts.sum(0))


def sample(docs: DataFrame, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` documents with a language, the least by hash of doc_id, found by their ids before texts are read."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    if not ids:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long"))
    return [(r.text, r.lang) for r in ready(docs.where("lang is not null"), "lang").join(few.distinct(), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct("lang", "text")).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").select("x.text", "x.lang").collect()]


def language(pages: DataFrame, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of each whole page.

    Null or empty html: no text evidence, the other evidence decides. Null url: host "", whose prior is that of all pages
    without one. Repeated rows count as often as they occur. Documents without languages, or an empty table: lang is null.
    Ties go to the language that is first in the alphabet.
    """
    langs, weights = fit(sample(docs, rows))
    spark, k = pages.sparkSession, len(langs)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in slices(batches):
            out = []
            for page in b.column("text").to_pylist():
                at = features(visible(page))
                total = w[at].sum(0, dtype=np.float64) if len(at) else np.zeros(w.shape[1])
                total *= min(1.0, EVIDENCE / max(1, len(at)))
                p = np.exp(total - total.max())
                out.append((p / p.sum())[:k])
            said = [declared(page) for page in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(said), *(pa.array([float(p[i]) for p in out]) for i in range(k))], names=["page_id", "url", "declared", *names])

    names = [f"p{i}" for i in range(k)]
    read = ready(pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").alias("text"), "url"), "url").withColumnRenamed("doc_id", "page_id")
    kinds = ", ".join(f"{n} double" for n in names)
    # Between the slashes and the path, without user, port and a last dot; letters of any script.
    authority = F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^\s/\\?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", ""))
    scored = cut(read.mapInArrow(tidied(make), f"page_id long, url string, declared string{', ' * bool(k)}{kinds}").select("page_id", host.alias("host"), "declared", *names))
    if not k:
        return scored.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))

    # Six values of what markup declares at most, so its table is bounded; everything else stays distributed.
    known = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared") == "", "").otherwise("other")
    sums = [F.sum(n).alias(n) for n in names]
    said = {r["known"]: np.array([r[n] for n in names]) for r in scored.groupBy(known.alias("known")).agg(*sums).collect()}
    overall = sum(said.values(), np.full(k, 1e-3))
    overall = overall / overall.sum()
    table = np.stack([said.get(x, np.zeros(k)) for x in [*langs, "", "other"]]) + 0.5
    table = np.log(table / table.sum(0))

    labels = F.split("host", r"\.")
    suffix = F.regexp_extract("host", r"([^.]*)$", 1)
    domain = F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.col("host"))
    hosts = scored.groupBy("host").agg(*sums).withColumn("domain", domain).withColumn("suffix", suffix)
    level = lambda by, tag: hosts.groupBy(by).agg(*(F.sum(n).alias(tag + n) for n in names))
    sized = hosts.join(level("domain", "d_"), "domain").join(level("suffix", "s_"), "suffix")
    total = lambda tag: sum((F.col(tag + n) for n in names), F.lit(0.0))
    mean_of_domain = [(F.col(f"d_{n}") + STRENGTH * float(overall[i])) / (total("d_") + STRENGTH) for i, n in enumerate(names)]
    of_host = [(F.col(n) + STRENGTH * m) / (total("") + STRENGTH) for n, m in zip(names, mean_of_domain, strict=True)]
    # Bayes: how likely this suffix is given the language, up to what all languages share.
    of_suffix = [(F.col(f"s_{n}") + STRENGTH * float(overall[i])) / (total("s_") + STRENGTH) / float(overall[i]) for i, n in enumerate(names)]
    priors = sized.select("host", *((F.log(h) + F.log(s)).alias(f"h_{n}") for n, h, s in zip(names, of_host, of_suffix, strict=True)))

    row = {x: table[j] for j, x in enumerate([*langs, "", "other"])}
    evidence = [
        F.log(F.col(n) + 1e-12) + F.col(f"h_{n}") + F.coalesce(*(F.when(known == x, float(v[i])) for x, v in row.items()), F.lit(0.0)) for i, n in enumerate(names)
    ]
    fused = scored.join(priors, "host").withColumn("e", F.array(*evidence)).withColumn("top", F.array_max("e"))
    name = lambda at: F.element_at(F.array(*map(F.lit, langs)), at.cast("int"))
    return fused.select(
        "page_id",
        "host",
        "declared",
        name(F.array_position(F.array(*names), F.greatest(*names) if k > 1 else F.col(names[0]))).alias("text_lang"),
        name(F.array_position("e", F.col("top"))).alias("lang"),
        (1 / F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("confidence"),
    )
