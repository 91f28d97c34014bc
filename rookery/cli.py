"""python -m rookery.cli <path> [--html] [--ai] | ask <path> "<question>" [--ai]; --ai needs a client, which main() is given."""

from __future__ import annotations

import os
import sys

from rookery.operators.search import QUESTION, answer, with_ids
from rookery.tables import settled

USAGE = 'usage: rookery <path> [--html] [--ai | --no-ai] | rookery ask <path> "<question>" [--ai | --no-ai]'


def _directory(path: str) -> str | None:
    return None if os.path.isdir(path) else f"not a directory: {path}"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _fail(text: str, code: int) -> int:
    print(text, file=sys.stderr)
    return code


def main(args: list[str], spark=None, client=None) -> int:
    """0: done; 1: no such directory, or the report would be written through a link; 2: wrong arguments.

    client: for --ai, a picklable function without arguments that gives complete(task, prompt) -> text (rookery.plans.prompts).
    """
    if "--help" in args or "-h" in args:
        print(USAGE)
        return 0
    literal = args.index("--") if "--" in args else len(args)
    options = {a for a in args[:literal] if a.startswith("-") and not any(c.isspace() for c in a)}
    words = [a for i, a in enumerate(args) if i != literal and not (i < literal and a in options)]
    if options - {"--html", "--no-ai", "--ai"}:
        return _fail(f"unknown option: {min(options - {'--html', '--no-ai', '--ai'})}\n{USAGE}", 2)
    if {"--ai", "--no-ai"} <= options:
        return _fail(f"--ai and --no-ai exclude each other\n{USAGE}", 2)
    if "--ai" in options and client is None:
        return _fail("--ai needs a client of a language model, which the command line does not have: call main() with one", 2)
    ask = bool(words) and words[0] == "ask"
    words = words[1:] if ask else words
    if not words:
        return _fail(USAGE, 1)
    if problem := _directory(words[0]):
        return _fail(problem, 1)
    if ask and (len(words) < 2 or not words[1].strip() or len(words[1]) > QUESTION):
        return _fail(f"a question of 1 to {QUESTION} characters is needed", 2)
    from rookery.model import build_model
    from rookery.plans import answers, prompts, report

    spark = spark or _session()
    model = build_model(spark, words[0])
    if ask:
        hits = settled(answer(spark, model.classes, model.properties, words[1]), "hits")
        told = None
        if "--ai" in options and (found := _retrieved(model, hits, words[1])):
            told = prompts.answered_question(client(), found)
        print(answers.answer_text(model.classes, model.properties, hits, words[1], told))
        return 0
    targets = [("architecture-report.md", report.markdown_lines)] + [("architecture-report.html", report.html_lines)] * ("--html" in options)
    for name, _ in targets:
        if os.path.islink(os.path.join(words[0], name)):
            return _fail(f"{name} is a link: not written", 1)
    classes = settled(prompts.narrated(model.classes, client), "narrated") if "--ai" in options else model.classes
    blocks = settled(report.report_blocks(classes, model.properties, model.dependencies, model.findings, model.build_files, words[0]), "blocks")
    for name, lines in targets:
        report.write_lines(lines(blocks), os.path.join(words[0], name))
    return 0


def _retrieved(model, hits, question: str) -> str:
    """The prompt for a question: what the hits are, in their order."""
    from rookery.plans import prompts

    classes = with_ids(prompts.class_prompts(model.classes), "class").join(hits.select("doc_id", "rank"), "doc_id").orderBy("rank").collect()
    configs = with_ids(prompts.config_prompts(model.properties), "config").join(hits.select("doc_id", "rank"), "doc_id").orderBy("rank").collect()
    return prompts.ask_prompt(question, [r["prompt"] for r in classes], model.classes.count(), [r["prompt"] for r in configs]) if classes or configs else ""


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
