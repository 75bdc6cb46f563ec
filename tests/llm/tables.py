"""Small tables in a folder, with the columns that the queries read."""

SCHEMAS = {
    "job_records": "job_id long, external_id string, source string, title string, company string, city string, date_posted string, date_ingested string, salary_min double, salary_raw string, employment_type string, experience_level string",
    "job_sources": "source string, trust_rank int, home_zone string, date_order string",
    "raw_ingested_jobs": "id long, ingestion_run_id string, source string, external_id string, title string, company string, city string, description string",
    "extracted_intelligence": "id long, normalized_job_id long, extracted_at timestamp, extraction_failed boolean, skills array<struct<skill_name: string, label: string>>, tools array<struct<tool_name: string, label: string>>",
    "documents": "doc_id long, text string",
    "golden_items": "item_id long, passage string",
    "canonical_values": "value_id long, field_name string, canonical string",
    "context_windows": "window_name string, capacity_tokens int",
}
SOURCES = [("alpha", 1, "UTC", "mdy"), ("beta", 2, "Europe/Berlin", "dmy")]


def folder(spark, path, extra=False, **tables):
    """The folder, after writing each table (a list of dicts or tuples); with `extra`, also a column with a clashing name."""
    for name, rows in tables.items():
        names = [c.strip().split()[0] for c in split(SCHEMAS[name])]
        data = [tuple(r.get(n) for n in names) if isinstance(r, dict) else r for r in rows]
        df = spark.createDataFrame(data, SCHEMAS[name])
        if extra:
            from pyspark.sql import functions as F

            for clash in ("key", "value", "block", "n", "word", "words", "text_", "root", "node", "share", "record"):
                if clash not in df.columns:
                    df = df.withColumn(clash, F.lit("x"))
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def split(schema):
    """The schema's columns, commas within angle brackets left alone."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]
