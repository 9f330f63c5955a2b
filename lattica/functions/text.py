"""Scalar functions on text as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def label_key(x: Column) -> Column:
    """squeeze() in lower case."""
    return F.lower(squeeze(x))


def sentences(x: Column) -> Column:
    """Sentences after ., ! or ? and white space; blank ones dropped."""
    return F.filter(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def chunks(parts: Column, most: int) -> Column:
    """Parts packed in order into chunks of at most `most` characters, joined by a space; a longer part is a chunk of its own."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + 1 + F.length(s) <= most)
        grown = F.when(acc["cur"] == "", s).otherwise(F.concat_ws(" ", acc["cur"], s))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"), F.when(fits, grown).otherwise(s).alias("cur")
        )

    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def relation_name(x: Column) -> Column:
    """A relation type of capitals, digits and single underscores; REL_ before a digit, RELATED_TO if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9_]", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_|_$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "RELATED_TO").when(t.rlike("^[0-9]"), F.concat(F.lit("REL_"), t)).otherwise(t)


#: Categories of temporary ids, and id prefixes in the order of their test, with their node types.
TEMP_TYPES = {
    "diseases": "Disease", "disease": "Disease", "symptoms": "Symptoms", "symptom": "Symptoms", "diagnostic_test": "DiagnosticTest", "diagnostictest": "DiagnosticTest",
    "examinations": "DiagnosticTest", "examination": "DiagnosticTest", "patient_characteristics": "PatientCharacteristics", "patientcharacteristics": "PatientCharacteristics",
    "treatments": "TreatmentIntervention", "treatment": "TreatmentIntervention", "treatmentintervention": "TreatmentIntervention", "intervention": "TreatmentIntervention",
}
ID_TYPES = (("SS", "Symptoms"), ("DT", "DiagnosticTest"), ("PC", "PatientCharacteristics"), ("TI", "TreatmentIntervention"), ("D", "Disease"))


def type_of_id(x: Column) -> Column:
    """Node type from an ontology id: of a temporary id by its category, else by prefix; null where neither is known."""
    category = F.lower(F.regexp_extract(x, r"^TEMP_([a-zA-Z_]+)_\d+", 1))
    table = F.create_map(*[F.lit(v) for kv in TEMP_TYPES.items() for v in kv])
    out = F.when(category != "", F.try_element_at(table, category))
    for prefix, kind in ID_TYPES:
        out = out.when(x.startswith(prefix), F.lit(kind))
    return out


def camel(x: Column) -> Column:
    """snake_case as CamelCase."""
    return F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def chapter_number(title: Column, ordinal: Column) -> Column:
    """The number a title starts with, else the ordinal with three digits."""
    n = F.regexp_extract(F.trim(title), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(F.coalesce(n, F.lit("")) != "", n).otherwise(F.lpad(ordinal.cast("string"), 3, "0"))


def estimated_page(line: Column, total: Column) -> Column:
    """Page 1 to 100 by the share of lines before."""
    return F.least(F.greatest(F.floor(line / total * 100.0) + 1, F.lit(1)), F.lit(100)).cast("bigint")


def json_object(x: Column) -> Column:
    """From the first { to the last }, '' if there is none."""
    return F.regexp_extract(x, r"(?s)\{.*\}", 0)


def json_array(x: Column) -> Column:
    """From the first [ to the last ], '' if there is none."""
    return F.regexp_extract(x, r"(?s)\[.*\]", 0)


def json_repair(x: Column) -> Column:
    """A reply without fences, comments, trailing commas and control characters."""
    t = F.regexp_replace(x, r"(?s)```[A-Za-z]*", "")
    t = F.regexp_replace(t, r"(?s)/\*.*?\*/", "")
    t = F.regexp_replace(t, r"(?m)(^|[\s,{\[])//[^\n]*", "$1")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    t = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    return F.replace(F.trim(t), F.lit("\\'"), F.lit("'"))


def codes(x: Column) -> Column:
    """Distinct codes of a list literal like [(12, 100.0), (7, 0.0)]; bad items are skipped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\(\s*(\d+)\s*,"), 1), lambda c: c.cast("bigint")))


def truth(x: Column) -> Column:
    """Booleans from true/false, 1/0 in any case, else null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def choice(reply: Column, valid: Column) -> Column:
    """The answer letter: of a JSON reply, else the first capital standing alone; null if it isn't valid."""
    named = F.upper(F.trim(F.get_json_object(json_object(reply), "$.answer")))
    single = F.regexp_extract(F.upper(reply), r"\b([A-Z])\b", 1)
    found = F.when(named.isNotNull() & F.array_contains(valid, named), named).otherwise(single)
    return F.when(F.array_contains(valid, found), found)


def section_title(x: Column) -> Column:
    """The title of a line 'section: ...' or '章节: ...', else unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?im)^\s*(章节|section)\s*[:：]\s*(.+)$", 2), F.lit("")), F.lit("unknown"))


def term_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else the Jaccard index of their characters, letter case aside."""
    a, b = F.lower(a), F.lower(b)
    sa, sb = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    inter, union = F.size(F.array_intersect(sa, sb)), F.size(F.array_union(sa, sb))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).otherwise(F.coalesce(F.try_divide(inter, union), F.lit(0.0)))


def temp_id(kind: Column, name: Column) -> Column:
    """TEMP_<kind>_<nnnn>, the number from a stable hash of the name."""
    return F.concat(F.lit("TEMP_"), kind, F.lit("_"), F.lpad(F.pmod(F.xxhash64(F.lower(name)), F.lit(10000)).cast("string"), 4, "0"))


def preview(x: Column, most: int = 200) -> Column:
    """The text, cut after `most` characters with ...."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def clean_lines(x: Column) -> Column:
    """Trimmed lines without blank ones."""
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def word_count(x: Column) -> Column:
    return F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+"))).cast("bigint")


def cache_key(x: Column) -> Column:
    """The key of a mapping cache: lower case, ends trimmed."""
    return F.lower(F.trim(x))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, else '' (F12, F13)."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit(""))


#: The property that names a node of each kind, in the order of their test.
NAMING = (("Knowledge", ("normalized_name", "name")), ("ECGFinding", ("name",)), ("Ontology", ("name_en",)), ("FindingLabel", ("name",)), ("DiseaseLabel", ("label",)))


def embedding_text(labels: Column, props: dict[str, Column]) -> Column:
    """The text of a node to embed, by its first known label; of other nodes the first of their usual names."""
    pick = lambda names: F.trim(F.coalesce(*[props.get(n, F.lit(None).cast("string")) for n in names], F.lit("")))
    out = None
    for label, names in NAMING:
        hit = F.array_contains(labels, label)
        out = F.when(hit, pick(names)) if out is None else out.when(hit, pick(names))
    return out.otherwise(first_text(*[props.get(n, F.lit(None).cast("string")) for n in ("name", "normalized_name", "name_en")]))


#: Properties that may hold an edge's type, its evidence, and its confidence, in the order of their test.
TYPE_KEYS = ("edge_type", "relation", "predicate", "sem_type", "type")
EVIDENCE_KEYS = ("source_sentence", "evidence_sentence", "sentence", "source", "evidence_text")
CONFIDENCE_KEYS = ("confidence", "sim_score", "similarity")


def edge_type(props: Column, rel: Column) -> Column:
    """The first type among an edge's JSON properties, else its relation."""
    return F.coalesce(*[F.get_json_object(props, f"$.{k}") for k in TYPE_KEYS], rel)


def edge_evidence(props: Column) -> Column:
    """The first non-empty evidence among an edge's JSON properties, null without one."""
    return F.coalesce(*[F.nullif(F.get_json_object(props, f"$.{k}"), F.lit("")) for k in EVIDENCE_KEYS])


def edge_confidence(props: Column) -> Column:
    """The first confidence among an edge's JSON properties, else 1."""
    return F.coalesce(*[F.get_json_object(props, f"$.{k}").try_cast("double") for k in CONFIDENCE_KEYS], F.lit(1.0))


def options_map(options: Column) -> Column:
    """A list of options as a map keyed by position."""
    return F.map_from_entries(F.transform(options, lambda v, i: F.struct(i.cast("string"), v)))


def or_first_option(answer: Column, options: Column) -> Column:
    """The answer, else the first key of the options."""
    return F.coalesce(answer, F.get(F.array_sort(F.map_keys(options)), 0))


def iso_utc(ts: Column) -> Column:
    """A time as ISO text with seconds and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def entity_line(key: Column, *names: Column) -> Column:
    """'- id: label', the label being the first name present."""
    return F.format_string("- %s: %s", key, F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("Unknown")))


def child_level(parent: Column) -> Column:
    """The level of a child: points in its parent's id plus one."""
    return (F.length(parent) - F.length(F.replace(parent, F.lit("."), F.lit(""))) + 1).cast("bigint")
