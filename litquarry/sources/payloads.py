"""Payloads of the record services, normalised to the record schema.

JSON payloads are read with ``from_json`` in the JVM. The XML of the article service mixes text and markup, which only a
real parser reads right, so it goes through a Python table function. A payload that is no JSON or XML gives no rows.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litquarry.functions.text import clean_text, find_id, py_clean, split_authors
from litquarry.schema import as_papers

# Addresses records link to.
ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/{}/"
EUROPE_URL = "https://europepmc.org/article/MED/{}"
DOI_URL = "https://doi.org/{}"


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EUROPE = T.StructType([T.StructField("resultList", T.StructType([T.StructField("result", T.ArrayType(_struct(
    "title", "abstractText", "journalTitle", "source", "pubYear", "firstPublicationDate", "doi", "pmid", "pmcid", "authorString", "pubType")))]))])
PREPRINTS = T.StructType([T.StructField("collection", T.ArrayType(_struct("title", "abstract", "authors", "date", "doi", "category")))])
SUMMARY = T.StructType(
    [*_struct("uid", "pmid", "title", "abstract", "fulljournalname", "source", "pubdate").fields,
     T.StructField("articleids", T.ArrayType(_struct("idtype", "value"))), T.StructField("authors", T.ArrayType(_struct("name"))),
     T.StructField("pubtype", T.ArrayType(T.StringType()))])


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_of(*columns: Column) -> Column:
    """First that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def _link(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.when(_or_empty(value) != "", F.concat(F.lit(head), value, F.lit(tail)))


def _records(payloads: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """(ord, r): one row per record, ordered by payload and place in it. Payload rows are (base, payload)."""
    parsed = payloads.select("base", F.posexplode(F.from_json("payload", schema)[path.split(".")[0]][path.split(".")[1]] if "." in path
                                                  else F.from_json("payload", schema)[path]).alias("pos", "r"))
    return parsed.select((F.col("base") + F.col("pos")).alias("ord"), "r", F.to_json("r").alias("raw"))


def from_europe(payloads: DataFrame) -> DataFrame:
    """Search results of the European service."""
    r = F.col("r")
    return as_papers(_records(payloads, EUROPE, "resultList.result").select(
        "ord", "raw", clean_text(r["title"]).alias("title"), clean_text(r["abstractText"]).alias("abstract"),
        split_authors(r["authorString"]).alias("authors"), clean_text(_first_of(r["journalTitle"], r["source"])).alias("journal"),
        _or_empty(r["pubYear"]).alias("year"), _first_of(r["firstPublicationDate"], r["pubYear"]).alias("date"),
        _or_empty(r["doi"]).alias("doi"), _or_empty(r["pmid"]).alias("pmid"), _or_empty(r["pmcid"]).alias("pmcid"),
        F.lit("Europe PMC").alias("source"),
        F.coalesce(_link(EUROPE_URL, r["pmid"]), _link(DOI_URL, r["doi"]), F.lit("")).alias("url"),
        clean_text(r["pubType"]).alias("publication_type"), F.lit(False).alias("is_preprint")))


def from_preprints(payloads: DataFrame, server: str) -> DataFrame:
    """Listing of a preprint server."""
    r = F.col("r")
    return as_papers(_records(payloads, PREPRINTS, "collection").select(
        "ord", "raw", clean_text(r["title"]).alias("title"), clean_text(r["abstract"]).alias("abstract"),
        split_authors(r["authors"]).alias("authors"), F.lit(server).alias("journal"), F.substring(_or_empty(r["date"]), 1, 4).alias("year"),
        _or_empty(r["date"]).alias("date"), _or_empty(r["doi"]).alias("doi"), F.lit(server).alias("source"),
        F.coalesce(_link(DOI_URL, r["doi"]), F.lit("")).alias("url"), F.lit("Preprint").alias("publication_type"),
        _or_empty(r["category"]).alias("category"), F.lit(True).alias("is_preprint")))


def from_summaries(payloads: DataFrame) -> DataFrame:
    """Summary records of the article service, one record a payload row (base, payload)."""
    s = payloads.select(F.col("base").alias("ord"), F.from_json("payload", SUMMARY).alias("r"), F.col("payload").alias("raw")).filter("r IS NOT NULL")
    r = F.col("r")
    pmid = _first_of(r["uid"], r["pmid"])
    return as_papers(s.select(
        "ord", "raw", clean_text(r["title"]).alias("title"), clean_text(r["abstract"]).alias("abstract"),
        F.transform(r["authors"], lambda a: _or_empty(a["name"])).alias("authors"),
        clean_text(_first_of(r["fulljournalname"], r["source"])).alias("journal"), F.substring(_or_empty(r["pubdate"]), 1, 4).alias("year"),
        _or_empty(r["pubdate"]).alias("date"), find_id(r["articleids"], "doi").alias("doi"), pmid.alias("pmid"),
        _first_of(find_id(r["articleids"], "pmc"), find_id(r["articleids"], "pmcid")).alias("pmcid"), F.lit("PubMed").alias("source"),
        F.coalesce(_link(ARTICLE_URL, pmid), F.lit("")).alias("url"), _or_empty(F.array_join(r["pubtype"], ", ")).alias("publication_type"),
        F.lit(False).alias("is_preprint")))


def search_ids(payload: str) -> list[str]:
    """Ids in a search answer of the article service."""
    return [str(i) for i in json.loads(payload).get("esearchresult", {}).get("idlist", []) if str(i).strip()]


class _Article:
    """Reads one article element: own text of a node, all text under a node, first match of several paths."""

    def __init__(self, node: ET.Element):
        self.node = node

    def own(self, *paths: str) -> str:
        return next((t for p in paths if (n := self.node.find(p)) is not None and (t := py_clean(n.text))), "")

    @staticmethod
    def all_of(node: ET.Element | None) -> str:
        return py_clean("".join(node.itertext())) if node is not None else ""

    def below(self, *paths: str) -> str:
        return next((t for p in paths if (t := self.all_of(self.node.find(p)))), "")

    def identifier(self, kind: str) -> str:
        """First identifier of the kind at any depth, those of cited articles included."""
        return next((py_clean(n.text) for n in self.node.iterfind(".//ArticleIdList/ArticleId") if n.get("IdType", "").lower() == kind), "")

    def abstract(self) -> str:
        parts = ((n.get("Label"), self.all_of(n)) for n in self.node.iterfind(".//Abstract/AbstractText"))
        return " ".join(f"{label}: {text}" if label else text for label, text in parts if text)

    def authors(self) -> list[str]:
        found = []
        for a in map(_Article, self.node.iterfind(".//AuthorList/Author")):
            found.append(f"{a.own('ForeName')} {a.own('LastName')}".strip() or a.own("CollectiveName"))
        return [a for a in found if a]

    def date(self) -> str:
        """Each part from the article's date, else from the issue's; padded if all three are there, else the year."""
        year, month, day = (self.own(f".//ArticleDate/{p}", f".//JournalIssue/PubDate/{p}") for p in ("Year", "Month", "Day"))
        return f"{year}-{month.zfill(2)}-{day.zfill(2)}" if year and month and day else year

    def row(self) -> tuple:
        pmid = self.own(".//MedlineCitation/PMID")
        kinds = [t for n in self.node.iterfind(".//PublicationTypeList/PublicationType") if (t := self.all_of(n))]
        article = self.node.find(".//Article")
        title = self.all_of(article.find("ArticleTitle")) if article is not None else ""
        return (
            title, self.abstract(), self.authors(), self.below(".//Journal/Title", ".//Journal/ISOAbbreviation"),
            self.own(".//JournalIssue/PubDate/Year", ".//ArticleDate/Year"), self.date(), self.identifier("doi"), pmid,
            self.identifier("pmc"), ARTICLE_URL.format(pmid) if pmid else "", ", ".join(kinds),
        )


def parse_articles(xml: str | None) -> list[tuple]:
    """Rows of an article set; an unreadable document gives none."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    return [_Article(n).row() for n in root.iterfind(".//PubmedArticle")]


ARTICLE_ROW = "pos bigint, title string, abstract string, authors array<string>, journal string, year string, date string, doi string, pmid string, pmcid string, url string, publication_type string"


class ArticleSet:
    """Table function: one article-set document to its articles."""

    def eval(self, xml: str) -> Iterator[tuple]:
        for k, row in enumerate(parse_articles(xml)):
            yield (k, *row)


def from_article_sets(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """Article-set documents (base, payload) by LATERAL join with the table function."""
    function = F.udtf(ArticleSet, returnType=ARTICLE_ROW)
    spark.udtf.register("litquarry_article_set", function)
    rows = spark.sql("SELECT p.base + a.pos AS ord, a.* FROM {payloads} p, LATERAL litquarry_article_set(p.payload) a", payloads=payloads)
    return as_papers(rows.drop("pos").withColumns({"source": F.lit("PubMed"), "is_preprint": F.lit(False)}))
