r"""Spark job: translate a table of documents.

    spark-submit --py-files glosswork.zip,backend.py glosswork/__main__.py DOCUMENTS OUTPUT \
        --translator backend:translate [options]

``DOCUMENTS`` is parquet with ``doc_id, text, lang``; ``backend:translate`` names a
callable ``(payload, model) -> reply``. Every field of ``RunOptions`` is an option.
Below ``OUTPUT`` the job writes ``documents`` (by kind), ``failures`` (segments whose
call failed), ``status`` (counters per model) and ``memory`` (pass it to the next run
with ``--memory`` to skip what is done).
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import typing
from collections.abc import Sequence

from pyspark.sql import SparkSession

from glosswork.operators.inference import OfflineTranslator, Translator
from glosswork.operators.reports import backend_status
from glosswork.operators.results import write_outputs
from glosswork.options import RunOptions
from glosswork.plans.corpus import CorpusRun, translate_corpus
from glosswork.session import configure, size_shuffles
from glosswork.sources.memory import MemoryStore, write_memory


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="glosswork")
    p.add_argument("documents")
    p.add_argument("output")
    p.add_argument("--translator", help="module:callable; without it texts are only marked")
    p.add_argument("--memory", help="translation memory of an earlier run")
    p.add_argument("--memory-store", help="translation memory that grows in place; used and added to")
    p.add_argument("--version", type=int, default=1, help="version of the memory written")
    p.add_argument("--data-bytes", type=int, help="size of the texts, to size shuffles")
    kinds = typing.get_type_hints(RunOptions)
    for field in dataclasses.fields(RunOptions):
        flag = "--" + field.name.replace("_", "-")
        if kinds[field.name] is bool:
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=field.default)
        else:
            kind = int if int in (kinds[field.name], *typing.get_args(kinds[field.name])) else str
            p.add_argument(flag, type=kind, default=field.default)
    return p.parse_args(argv)


def load_translator(name: str | None, options: RunOptions) -> Translator:
    if not name:
        return OfflineTranslator(options.lang_out, direct=options.transport == "direct")
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, args: argparse.Namespace) -> CorpusRun:
    options = RunOptions(**{f.name: getattr(args, f.name) for f in dataclasses.fields(RunOptions)})
    configure(spark)
    if args.data_bytes:
        size_shuffles(spark, args.data_bytes)
    store = MemoryStore(spark, args.memory_store) if args.memory_store else None
    memory = spark.read.parquet(args.memory) if args.memory else store
    done = translate_corpus(
        spark, spark.read.parquet(args.documents), load_translator(args.translator, options), options, memory, args.version
    )
    output = args.output.rstrip("/")
    write_outputs(done.documents, f"{output}/documents")
    done.segments.where("error IS NOT NULL").select("seg_id", "error").write.parquet(f"{output}/failures")
    backend_status(done.audited).write.parquet(f"{output}/status")
    if store:
        store.add(done.fresh)
        store.merge()
    else:
        write_memory(done.memory, f"{output}/memory", args.version)
    return done


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    run(SparkSession.builder.appName("glosswork").getOrCreate(), args)


if __name__ == "__main__":
    main()
