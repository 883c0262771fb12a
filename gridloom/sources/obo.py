"""OBO ontologies as term rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# property_value keys of a term that are flags.
FLAGS = {
    "is_microtype": "is_microtype",
    "is_valid_dimension": "is_dimension",
    "is_valid_dimension_variable": "is_dimension_variable",
    "is_valid_data_variable": "is_data_variable",
    "is_valid_property": "is_property",
    "is_hidden": "is_hidden",
}


def _one(key: str, pattern: str = r"(.*?)") -> Column:
    return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{key}:\s*{pattern}\s*$", 1)), F.lit(""))


def _all(key: str, pattern: str) -> Column:
    return F.regexp_extract_all("value", F.lit(rf"(?m)^{key}:\s*{pattern}"), 1)


def scan_obo(spark: SparkSession, path, ontology_id: str) -> DataFrame:
    """One row per ``[Term]`` stanza: id, name, definition, all parents, synonyms, references, flags, units, properties.

    Files split at the stanza heads, so stanzas are read in parallel whatever their line ends and blank lines are. A
    record ends at the head of another kind of stanza; the part before the first term has no id.
    """
    stanzas = spark.read.text(path, lineSep="\n[Term]").withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    stanzas = stanzas.withColumn("value", F.regexp_extract("value", r"(?s)\A(.*?)(?:\n\s*\[[A-Za-z]+\]|\z)", 1))
    stanzas = stanzas.filter(F.col("value").rlike(r"(?m)^id:\s*\S"))
    props = F.regexp_extract_all("value", F.lit(r"(?m)^property_value:\s*(\S+\s+\"[^\"]*\")"), 1)

    def prop(key: str) -> Column:
        return F.nullif(F.regexp_extract("value", rf'(?m)^property_value:\s*{key}\s+"([^"]*)"', 1), F.lit(""))

    flags = [F.coalesce(F.lower(prop(key)) == "true", F.lit(False)).alias(out) for key, out in FLAGS.items()]
    units = lambda key: F.filter(F.split(F.coalesce(prop(key), F.lit("")), r"\s+"), lambda x: x != "")
    # several values of one key are joined with ";"
    pairs = F.transform(props, lambda p: F.struct(F.split(p, r"\s+", 2)[0].alias("k"), F.regexp_extract(p, '"([^"]*)"', 1).alias("v")))
    merged = F.map_from_arrays(
        F.array_distinct(F.transform(pairs, lambda e: e["k"])),
        F.transform(
            F.array_distinct(F.transform(pairs, lambda e: e["k"])),
            lambda k: F.array_join(F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"]), ";"),
        ),
    )
    parents = _all("is_a", r"([^\s!]+)")
    out = stanzas.select(
        _one("id").alias("term_id"),
        _one("name").alias("term_name"),
        F.lit(ontology_id).alias("ontology_id"),
        _one("def", r'"(.*)".*').alias("definition"),
        parents.alias("parents"),
        F.try_element_at(parents, F.lit(1)).alias("parent_first"),
        _all("synonym", r'"([^"]*)"').alias("synonyms"),
        _one("xref", r"Ref:\s*(\S+)").alias("ref"),
        _one("xref", r"ORef:\s*(\S+)").alias("oref"),
        prop("data_type").alias("scalar_type"),
        *flags,
        units("valid_units").alias("valid_units"),
        units("valid_units_parent").alias("valid_units_parents"),
        merged.alias("properties"),
    )
    return out.filter(F.col("term_id").isNotNull())


def obo_stanza(terms: DataFrame) -> DataFrame:
    """Terms back to stanzas, one text row each, for ``write.text(lineSep="\\n\\n")``."""
    lines = F.concat_ws(
        "\n",
        F.lit("[Term]"),
        F.concat(F.lit("id: "), "term_id"),
        F.concat(F.lit("name: "), "term_name"),
        F.concat(F.lit('def: "'), F.col("definition"), F.lit('" []')),
        F.array_join(F.transform("synonyms", lambda s: F.concat(F.lit('synonym: "'), s, F.lit('" EXACT []'))), "\n"),
        F.array_join(F.transform("parents", lambda p: F.concat(F.lit("is_a: "), p, F.lit(" ! parent"))), "\n"),
        F.array_join(
            F.transform("flags", lambda f: F.concat(F.lit("property_value: "), f, F.lit(' "true" xsd:boolean'))), "\n"
        ),
    )
    return terms.select(F.regexp_replace(lines, r"\n{2,}", "\n").alias("value"))
