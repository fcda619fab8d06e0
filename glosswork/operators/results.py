"""Result records, output files and assembled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.frames import compute_once
from glosswork.functions.json_values import child, is_json_null, is_object, record_json, string_only, too_large, with_json
from glosswork.functions.paths import relative_inside, resolve
from glosswork.functions.text import js_strip
from glosswork.options import MODES

RECORD = ("input_pdf", "mono_pdf", "dual_pdf")
DUAL_LABEL, MONO_LABEL = "[双语]", "[中文]"


def contract_error(value: Column) -> Column:
    """First rule a result record breaks, NULL if it keeps all of them:
    ``object``, ``input_pdf``, ``mono_pdf``, ``dual_pdf``, ``both_null``."""
    def filled(name: str) -> Column:
        return F.coalesce(F.length(string_only(child(value, f"$.{name}"))) > 0, F.lit(False))

    def null(name: str) -> Column:
        return is_json_null(child(value, f"$.{name}"))

    return (
        F.when(~is_object(value), "object")
        .when(~filled("input_pdf"), "input_pdf")
        .when(~(filled("mono_pdf") | null("mono_pdf")), "mono_pdf")
        .when(~(filled("dual_pdf") | null("dual_pdf")), "dual_pdf")
        .when(null("mono_pdf") & null("dual_pdf"), "both_null")
    )


def salvage_results(logs: DataFrame) -> DataFrame:
    """Find the result record in each job's standard output.

    Output that is one JSON value is checked as it is. Otherwise its lines are
    searched from the end for the last complete object that keeps the contract.
    Adds ``input_pdf, mono_pdf, dual_pdf``, ``recovered`` (found amid noise) and
    ``problem`` (``parse`` or the broken rule). Outputs and lines may have any length a
    string has. All of it is row-local.
    """
    whole = js_strip(F.col("stdout"))
    lines = F.filter(
        F.transform(F.split(F.col("_whole"), "\r\n|\n|\r"), js_strip),
        lambda s: s.startswith("{") & s.endswith("}"),
    )
    candidates = F.filter(
        F.transform(lines, lambda s: record_json(s, RECORD)), lambda v: v.isNotNull() & contract_error(v).isNull()
    )
    stripped = logs.withColumn("_whole", whole)
    large = too_large(F.col("_whole"))
    parsed = with_json(stripped, F.when(~large, F.col("_whole")), "_parsed")
    found = (
        compute_once(parsed, {"_strict": F.when(large, record_json(F.col("_whole"), RECORD)).otherwise(F.col("_parsed"))})
        # Only outputs that are no JSON value pay for the line search.
        .withColumn("_last", F.when(F.col("_strict").isNull(), F.try_element_at(candidates, F.lit(-1))))
    )
    problem = F.when(F.col("_strict").isNotNull(), contract_error(F.col("_strict"))).when(
        F.col("_last").isNull(), "parse"
    )
    done = compute_once(found, {"problem": problem}).withColumn(
        "_record", F.when(F.col("problem").isNull(), F.coalesce("_strict", "_last"))
    )
    return done.select(
        *logs.columns,
        *[string_only(child(F.col("_record"), f"$.{n}")).alias(n) for n in RECORD],
        (F.col("_strict").isNull() & F.col("_last").isNotNull()).alias("recovered"),
        "problem",
    )


def result_records(results: DataFrame) -> DataFrame:
    """One JSON record per result, nulls written out, non-ASCII text kept."""
    record = F.to_json(F.struct("input_pdf", "mono_pdf", "dual_pdf"), {"ignoreNullFields": "false"})
    return results.select("job_id", record.alias("record"))


def output_manifest(results: DataFrame, files: DataFrame, output_dir: str, root: str, mode: str = "both") -> DataFrame:
    """Output files of each result, dual before mono, with title and status.

    Relative paths start at ``output_dir``. Files outside ``root`` are left out.
    Status is ``ok`` or ``missing_file``; a result without any file to offer
    gets one row with NULL kind and status ``no_output`` or ``outside_root``.
    ``results`` has ``job_id, title, mono_pdf, dual_pdf``.
    """
    def output(kind_: str, label: str, column: str, place: int) -> Column:
        path = resolve(F.col(column), F.lit(output_dir))
        return F.struct(
            F.lit(place).alias("place"),
            F.lit(kind_).alias("kind"),
            path.alias("path"),
            relative_inside(path, F.lit(root)).alias("rel_path"),
            F.concat(F.lit(label + " "), F.col("title")).alias("label"),
        )

    wanted = []
    if mode in ("dual", "both"):
        wanted.append(output("dual", DUAL_LABEL, "dual_pdf", 0))
    if mode in ("mono", "both"):
        wanted.append(output("mono", MONO_LABEL, "mono_pdf", 1))
    offered = results.select(
        "job_id", F.filter(F.array(*wanted), lambda o: o["path"].isNotNull()).alias("_offered")
    ).withColumn("_inside", F.filter("_offered", lambda o: o["rel_path"].isNotNull()))
    nothing = F.when(F.size("_offered") == 0, "no_output").when(F.size("_inside") == 0, "outside_root")
    rows = offered.select("job_id", nothing.alias("_nothing"), F.inline_outer("_inside"))
    existing = files.select("path").distinct().withColumn("_exists", F.lit(True))
    return rows.join(existing, "path", "left").select(
        "job_id",
        "place",
        "kind",
        "rel_path",
        "label",
        F.coalesce("_nothing", F.when(F.col("_exists"), "ok").otherwise("missing_file")).alias("status"),
    )


def job_verdicts(manifest: DataFrame) -> DataFrame:
    """``job_id``, ``n_ok`` and ``verdict`` of every job in an ``output_manifest``: a
    job fails as a whole where any file it declares is missing (``missing_file``) or
    it has nothing to offer (``no_output``, ``outside_root``); else ``ok``."""
    fault = F.when(F.col("status") != "ok", F.col("status"))
    return manifest.groupBy("job_id").agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.coalesce(F.max(fault), F.lit("ok")).alias("verdict")
    )


def assemble(translated: DataFrame, mode: str = "dual") -> DataFrame:
    """Documents from segments: one row per document and kind.

    ``translated`` has ``doc_id, pos, text, result`` with a NULL result where the
    source passes through. ``mono`` holds the translated lines in order,
    ``dual`` each source line followed by its translation (once, if there is
    none). A document came in as one value and leaves as one; both kinds are
    built from one grouping.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    mono_line = F.coalesce("result", "text")
    dual_line = F.concat_ws("\n", "text", "result")
    kinds = [k for k in ("dual", "mono") if mode in (k, "both")]
    columns = {"dual": dual_line, "mono": mono_line}
    lines = F.sort_array(F.collect_list(F.struct("pos", *[columns[k].alias(k) for k in kinds])))
    grouped = translated.groupBy("doc_id").agg(
        lines.alias("_lines"), F.count("*").alias("n_segments"), F.count("result").alias("n_translated")
    )
    def joined(name: str) -> Column:
        return F.array_join(F.transform("_lines", lambda line: line.getField(name)), "\n")

    outputs = F.array(*[F.struct(F.lit(k).alias("kind"), joined(k).alias("text")) for k in kinds])
    return grouped.select("doc_id", "n_segments", "n_translated", F.inline(outputs))


def write_outputs(assembled: DataFrame, path: str) -> None:
    """Assembled documents as parquet, one folder per kind."""
    assembled.write.mode("errorifexists").partitionBy("kind").parquet(path)


def write_manifest(results: DataFrame, path: str) -> None:
    """One JSON record per line."""
    result_records(results).select(F.col("record").alias("value")).write.mode("errorifexists").text(path)
