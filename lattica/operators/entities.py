"""Entity normalisation, review of suggestions, and calls to injected models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.python_text import fuzzy_ratio_udf


def call_model(df: DataFrame, text: str, out: str, model: Callable[[list[str]], list], kind: str = "string") -> DataFrame:
    """A column by an injected model, batch by batch; the model gets a list of texts and gives as many answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: model(f[text].tolist())})

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` {kind}"
    return df.mapInPandas(run, schema)


def exact_names(ontology: DataFrame) -> DataFrame:
    """(name, ontology_id) of English and Chinese names."""
    return ontology.select(F.col("name_en").alias("name"), "ontology_id").unionByName(ontology.select(F.col("name_cn").alias("name"), "ontology_id"))


def fuzzy_candidates(texts: DataFrame, names: DataFrame, fuzzy: float) -> DataFrame:
    """(k, n, f_id, s): names with a ratio of at least `fuzzy` to each text k.

    Of two texts with a ratio r the lengths differ by a factor r / (200 - r)
    at most, so names of other length classes are never compared; no name at
    the ratio is missed.
    """
    low, high = fuzzy / (200 - fuzzy), (200 - fuzzy) / fuzzy
    open_ = texts.select("k", F.explode(F.sequence(F.floor(F.length("k") * low / 8), F.floor(F.length("k") * high / 8))).alias("g"))
    pool = names.groupBy(F.lower(F.trim("name")).alias("n")).agg(F.min("ontology_id").alias("f_id")).withColumn("g", F.floor(F.length("n") / 8))
    return open_.join(pool, "g").withColumn("s", fuzzy_ratio_udf("k", "n")).filter(F.col("s") >= fuzzy).drop("g")


def cascade(mentions: DataFrame, cache: DataFrame, names: DataFrame, fuzzy_names: DataFrame | None = None, fuzzy: float = 80.0, model: Callable[[list[str]], list] | None = None, top: int = 6) -> DataFrame:
    """(mention_id, text, ontology_id, method): cache, exact name, best fuzzy name, model, else new.

    mentions: mention_id, text; cache: key, ontology_id; names: name,
    ontology_id, of which `fuzzy_names` (English ones) are compared fuzzily.
    Each distinct text is settled once. An injected model gets what is left,
    each text with its `top` nearest names as "text\\nid|name\\n...", and
    gives an id or None. The first mention of a text keeps the method that
    settled it, later ones are cache hits. Null and blank texts are new.
    """
    key = F.lower(F.trim("text"))
    texts = mentions.select(key.alias("k")).filter("k <> ''").distinct()
    known = cache.groupBy(F.lower(F.trim("key")).alias("k")).agg(F.min("ontology_id").alias("c_id"))
    exact = names.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("ontology_id").alias("e_id"))
    pool = names if fuzzy_names is None else fuzzy_names
    settled = texts.join(known, "k", "left").join(exact, "k", "left")
    scored = fuzzy_candidates(settled.filter("c_id is null and e_id is null").select("k"), pool, fuzzy)
    best = scored.groupBy("k").agg(F.max_by("f_id", F.struct("s", F.reverse("n"))).alias("f_id"))
    done = settled.join(best, "k", "left").withColumn("m_id", F.lit(None).cast("string"))
    if model is not None:
        left = done.filter("c_id is null and e_id is null and f_id is null").select("k")
        w = Window.partitionBy("k").orderBy(F.desc("s"), "n")
        near = fuzzy_candidates(left, pool, 1.0).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
        asked = near.groupBy("k").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", F.format_string("%02d", "r"), "f_id", "n")))).alias("near"))
        prompts = left.join(asked, "k", "left").select("k", F.concat_ws("\n", "k", "near").alias("prompt"))
        answers = call_model(prompts, "prompt", "answer", model).select("k", F.col("answer").alias("_m"))
        done = done.join(answers, "k", "left").withColumn("m_id", F.col("_m")).drop("_m")
    method = F.when(F.col("c_id").isNotNull(), "cache_hit").when(F.col("e_id").isNotNull(), "exact").when(F.col("f_id").isNotNull(), "fuzzy").when(F.col("m_id").isNotNull(), "llm_match").otherwise("new_entity")
    done = done.select("k", F.coalesce("c_id", "e_id", "f_id", "m_id").alias("ontology_id"), method.alias("settled"))
    firsts = mentions.groupBy(key.alias("k")).agg(F.min("mention_id").alias("first_id"))
    x = mentions.withColumn("k", key).join(done, "k", "left").join(firsts, "k", "left")
    told = F.coalesce("settled", F.lit("new_entity"))
    return x.select("mention_id", "text", "ontology_id", F.when((F.col("mention_id") > F.col("first_id")) & (told != "new_entity"), "cache_hit").otherwise(told).alias("method"))


def link_concepts(names: DataFrame, concepts: DataFrame, allowed: tuple[str, ...], coded: tuple[str, ...]) -> DataFrame:
    """(key, cui, concept_name, codes): concepts of a name whose aliases (vocabulary:code) come from an allowed vocabulary, with their codes of others.

    names: key, name; concepts: cui, concept_name, term, aliases. The join is by
    lower-cased term; null and blank names link to nothing.
    """
    vocabulary = lambda a: F.split_part(a, F.lit(":"), F.lit(1))
    c = concepts.filter(F.exists("aliases", lambda a: vocabulary(a).isin(*allowed)))
    codes = F.transform(F.filter("aliases", lambda a: vocabulary(a).isin(*coded)), lambda a: F.split_part(a, F.lit(":"), F.lit(2)))
    x = names.filter(F.trim("name") != "").select("key", F.lower(F.trim("name")).alias("term"))
    return x.join(c.select("cui", "concept_name", F.lower(F.trim("term")).alias("term"), codes.alias("codes")), "term").select("key", "cui", "concept_name", "codes")


def review_route(action: Column, target: Column, confidence: Column, least: float = 0.8) -> Column:
    """Route of a reviewed suggestion; without enough confidence, or a mapping without target, it goes to manual review."""
    a = F.lower(F.trim(action))
    sure = F.coalesce(confidence, F.lit(0.0)) > least
    return F.when(~sure, "manual").when(a == "adopt", "adopted").when((a == "map") & target.isNotNull(), "mapped").when(a == "reject", "rejected").otherwise("manual")


def overlay_cache(cache: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cache entries with accepted mappings laid over; the newest of a key wins, spaces of names become _."""
    new = accepted.groupBy("cache_key").agg(F.max_by(F.struct(F.get("ids", 0).alias("ontology_id"), F.replace("name", F.lit(" "), F.lit("_")).alias("normalized_name")), "at").alias("n"))
    return cache.join(new, "cache_key", "full_outer").select("cache_key", F.coalesce("n.ontology_id", "ontology_id").alias("ontology_id"), F.coalesce("n.normalized_name", "normalized_name").alias("normalized_name"))


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with their ordinal within a group, from 1."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def share_of_mode(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, rate): how large a part of a question's answers its most frequent one is."""
    c = df.groupBy(key, answer).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg((F.max("n") / F.sum("n")).alias("rate"))


def evidence_recall(gold: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """(key, recall): the share of a question's different gold items that were found."""
    own = gold.select(key, item).distinct().join(found.select(item).distinct().withColumn("_hit", F.lit(1)), item, "left")
    return own.groupBy(key).agg((F.count("_hit") / F.count("*")).alias("recall"))
