"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm import cells, components, entities, fusion, lookalikes, minhash, mixing, packing, tokens
from litquarry.llm.sql import oracle_sql
from litquarry.operators.timestamps import normalise_dates
from litquarry.session import load, materialise, spread

WS = r"[\x1c-\x1f\p{IsWhite_Space}]+"
#: Publication types that only say that none is given.
NO_TYPE = r"(?i)^[\W_]*(?:(?:n/?a|none|null|nil|unknown|unspecified|not (?:available|given|stated|specified)|n\.d\.)[\W_]*)*$"


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """Preprints with the records of papers that report the same study, and the confidence of each."""

    def table(name: str, key: str) -> DataFrame:
        df = spread(load(spark, d, name, key, "title", "authors", "pub_date", "source", "doi"))
        dated = normalise_dates(df, load(spark, d, "feeds"), year_col="pub_date")
        return dated.select(F.col(key).alias("id"), "title", "authors", F.substring("date_norm", 1, 7).alias("month"),
                            cells.doi_key(F.col("doi")).alias("identifier"))

    found = entities.match(table("preprints", "preprint_id"), table("papers", "paper_id"))
    return found.select(F.col("left_id").alias("preprint_id"), F.col("right_id").alias("paper_id"), "confidence")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The matched pairs alone."""
    return p2_matches(spark, d).drop("confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked record of papers with the group it belongs to."""
    links = load(spark, d, "match_links", "left_id", "right_id")
    return components.connected_groups(links, "left_id", "right_id", id_col="paper_id")


def _paper_claims(spark: SparkSession, d: str) -> DataFrame:
    """What each grouped record of papers says in the four fields, with the stated preference among the values."""
    groups = p3_found(spark, d)
    papers = load(spark, d, "papers", "paper_id", "abstract", "pmcid", "publication_type", "source", "fetched_at")
    feeds = load(spark, d, "feeds")
    src = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    trust = feeds.groupBy(F.lower(F.trim("source")).alias("src")).agg(F.min("trust_rank").alias("trust_rank"))
    abstract = F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), WS, " "))
    # the long text is reduced to its length and hash before anything shuffles
    slim = papers.select(
        "paper_id", "fetched_at", src.alias("src"),
        F.when(F.size(F.split(abstract, " ")) >= 5, F.struct(F.xxhash64(abstract).alias("k"), F.length(abstract).alias("n"))).alias("abstract"),
        F.when(F.col("pmcid").rlike("[1-9]"), F.struct(F.xxhash64(F.regexp_extract("pmcid", "([1-9][0-9]*)", 1)).alias("k"), F.lit(0).alias("n"))).alias("pmcid"),
        F.when(~F.coalesce("publication_type", F.lit("")).rlike(NO_TYPE), F.struct(F.xxhash64(F.lower(F.trim("publication_type"))).alias("k"), F.lit(0).alias("n"))).alias("publication_type"),
        F.when(src != "", F.struct(F.xxhash64(src).alias("k"), F.lit(0).alias("n"))).alias("source"),
    )
    fields = ("abstract", "pmcid", "publication_type", "source")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    return (
        slim.join(groups, "paper_id").join(trust, "src", "left")
        .select("group_id", "paper_id", "src", "fetched_at", F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("trust"), each.alias("f"))
        .filter("f.value IS NOT NULL")
        .select(
            "group_id", F.col("f.field_name").alias("field_name"), F.col("paper_id").alias("record_id"), "src",
            F.col("f.value.k").alias("value_key"), F.col("f.value.n").alias("size"), (-F.col("trust")).alias("trust"),
            F.coalesce("fetched_at", F.lit("1900-01-01").cast("timestamp")).alias("fetched_at"), (-F.col("paper_id")).alias("smallest"),
        )
    )


#: The stated preference among values, the first first, each to be maximised.
PREFERENCE = ["size", "trust", "fetched_at", "smallest"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group and field by the stated order of preference. It is total, so no vote could change it."""
    return fusion.preferred(_paper_claims(spark, d), PREFERENCE).withColumnRenamed("record_id", "paper_id")


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same by maximum posterior with a flat prior: the votes of the sources, discounted for copying, decide."""
    claims = materialise(_paper_claims(spark, d), "paper-claims")
    return fusion.fuse(claims, PREFERENCE, strength=0.0).withColumnRenamed("record_id", "paper_id")


def _near_papers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = spread(load(spark, d, "papers", "paper_id", "title", "abstract"))
    texts = papers.select(F.col("paper_id").alias("id"), F.concat_ws(" ", "title", "abstract").alias("text"))
    return minhash.near_duplicate_classes(texts, threshold=0.8, n=1, min_size=30, max_bands=32)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of records whose word sets are alike enough."""
    members, pairs = _near_papers(spark, d)
    return minhash.expand(members, pairs).select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of identical word sets and the number of other classes it is near to."""
    members, pairs = _near_papers(spark, d)
    ends = pairs.select(F.col("a").alias("class_id")).unionAll(pairs.select(F.col("b").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(links, "class_id", "left").select(F.col("id").alias("paper_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What each incoming record repeats, among papers and the batches before its own."""

    def rows(table: str, key: str, seq) -> DataFrame:
        df = load(spark, d, table)
        return df.select(F.col(key).alias("id"), seq.cast("int").alias("seq"), F.col("title").alias("text"),
                         cells.doi_key(F.col("doi")).alias("doi"), cells.pmid_key(F.col("pmid")).alias("pmid"))

    incoming = rows("incoming", "incoming_id", F.col("batch_no"))
    index = cells.CellIndex.create(rows("papers", "paper_id", F.lit(0)), threshold=0.8, min_words=6)
    batches = index.prepare(incoming)
    # the batches as they arrive: each is probed, then appended, in turn; of those without any vector the keys count
    numbers = sorted(r[0] for r in incoming.select("seq").filter("seq IS NOT NULL").distinct().collect())
    found = [index.probe_and_append(batches.batch(k), f"batch-{k}") for k in numbers]
    none = incoming.select(F.col("id").alias("known_id"), F.col("id").alias("new_id")).limit(0)
    return functools.reduce(DataFrame.unionAll, found or [none]).select("known_id", F.col("new_id").alias("incoming_id"))


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents", "doc_id", "source", "text"))
    return materialise(docs.select(F.col("doc_id").alias("id"), "source", tokens.token_count(F.col("text")).alias("tokens")), "token-sizes")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one larger than a container, for each capacity."""
    packed = packing.pack_table(_token_sizes(spark, d).select("id", "tokens"), load(spark, d, "pack_specs"))
    return packed.withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used for each capacity, and the share of them that stays empty."""
    by = p8_packed(spark, d).groupBy("spec_name").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    full = F.col("n_containers") * F.col("capacity_tokens")
    return by.join(load(spark, d, "pack_specs"), "spec_name").select(
        "spec_name", "capacity_tokens", "n_containers", "n_tokens", (1 - F.col("n_tokens") / full).alias("unused_share"))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document placed, none overfull, pieces gapless, nothing split that fits."""
    sizes = _token_sizes(spark, d).select("id", "tokens")
    specs = load(spark, d, "pack_specs").withColumn("capacity_tokens", F.col("capacity_tokens").cast("long"))
    packed = materialise(packing.pack_table(sizes, specs), "packed")
    filled = packed.groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("n")).join(specs, "spec_name")
    overfull = filled.groupBy("spec_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    whole = packed.groupBy("spec_name", "id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("reach"))
    whole = whole.join(sizes, "id").join(specs, "spec_name")
    broken = (F.col("n") != F.col("tokens")) | (F.col("pieces") != F.col("last")) | (F.col("reach") != F.col("tokens"))
    kept = whole.groupBy("spec_name").agg(
        F.count("*").alias("n_documents"), F.count_if(broken).alias("n_broken"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_split_small"))
    return kept.join(overfull, "spec_name").select("spec_name", "n_documents", "n_overfull", "n_broken", "n_split_small")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixes: shares within a thousandth of their targets (and a document), repeats within bounds."""
    selection, report = mixing.mix(_token_sizes(spark, d), load(spark, d, "mix_targets"))
    # a quota is met but for less than one document a shard: the largest document of the mix bounds that
    largest = selection.groupBy("mix_name").agg(F.max("tokens").alias("largest"))
    whole = report.groupBy("mix_name").agg(F.sum("tokens_used").alias("mix_tokens"))
    slack = 0.001 + F.col("largest") / F.col("mix_tokens")
    return report.join(largest, "mix_name", "left").join(whole, "mix_name").select(
        "mix_name", "source", "target_share", (F.abs(F.col("share_reached") - F.col("target_share")) <= slack).alias("within_share"),
        (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), (F.col("n_docs") > 0).alias("has_documents"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their number of uses and the share their source reached."""
    selection, report = mixing.mix(_token_sizes(spark, d), load(spark, d, "mix_targets"))
    reached = report.select("mix_name", "source", "share_reached")
    return selection.join(reached, ["mix_name", "source"]).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in each mix."""
    return mixing.mix(_token_sizes(spark, d), load(spark, d, "mix_targets"))[1]


def _stored_forms(spark: SparkSession, d: str) -> DataFrame:
    return materialise(lookalikes.stored_forms(spread(load(spark, d, "documents", "doc_id", "text")), "doc_id", "text"), "forms")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of those that look the same, and the number of texts the class is stored as."""
    return lookalikes.look_classes(_stored_forms(spark, d)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look the same and are stored differently."""
    return lookalikes.same_look_pairs(_stored_forms(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every document that has one differing from its text, with what was found in it."""
    docs = load(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    formed = docs.select("doc_id", "text", lookalikes.consistent(F.col("text")).alias("c"))
    return formed.filter("c.form <> text").select("doc_id", "c.form", "c.mixed_tokens", "c.whole_tokens")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_matches, p3_found, p4_found, p4_fused, p5_found, p5_classes, p6_found, p8_packed, p8_fill, p8_placed, p9_mixed, p9_shares, p9_kept, p10_found, p10_classes, p10_forms)}


__all__ = ["oracle_sql", "queries"]
