"""Commands over corpus and question files; see ``jobs`` for what they write under OUT.

    python -m lodestar process embedding|index|graph|all CORPUS OUT
    python -m lodestar retrieve METHOD OUT QUESTIONS
    python -m lodestar retry METHOD OUT QUESTIONS
    python -m lodestar evaluate result|labels METHOD OUT QUESTIONS
    python -m lodestar evaluate semantic|structure OUT
    python -m lodestar compare METHOD METHOD OUT
    python -m lodestar questions generate|validate|filter|all OUT
    python -m lodestar classify SCHEME OUT QUESTIONS
    python -m lodestar pipeline CORPUS QUESTIONS OUT --method METHOD
    python -m lodestar query NAME TABLES OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **choices: list[str]) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for place in places:
            sub.add_argument(place, choices=choices.get(place))
        sub.add_argument("--no-resume", action="store_true")
        return sub

    add("process", "stage", "corpus", "out", stage=["embedding", "index", "graph", "all"])
    base = {"choices": jobs.BASES, "default": "graph", "help": "what iterative answering retrieves by"}
    add("retrieve", "method", "out", "questions", method=jobs.METHODS).add_argument("--retriever-type", **base)
    add("retry", "method", "out", "questions", method=["naive", "graph"])
    judge = add("evaluate", "what", what=["result", "labels", "semantic", "structure"])
    judge.add_argument("rest", nargs="+", help="METHOD OUT QUESTIONS, or OUT")
    judge.add_argument("--hubness-k", type=int, default=10)
    judge.add_argument("--skip-llm", action="store_true", help="leave out the labels")
    judge.add_argument("--retriever-type", **base)
    add("compare", "first", "second", "out", first=jobs.METHODS, second=jobs.METHODS)
    asks = add("questions", "step", "out", step=["generate", "validate", "filter", "all"])
    for kind, n in (("single-hop", 50), ("multi-hop", 50), ("summary", 20)):
        asks.add_argument(f"--{kind}", type=int, default=n)
    asks.add_argument("--append", action="store_true")
    add("classify", "scheme", "out", "questions")
    whole = add("pipeline", "corpus", "questions", "out")
    whole.add_argument("--method", default="graph", choices=[*jobs.METHODS, "all"])
    whole.add_argument("--retriever-type", **base)
    whole.add_argument("--skip-llm", action="store_true")
    whole.add_argument("--skip-process", action="store_true")
    whole.add_argument("--skip-eval", action="store_true")
    add("query", "name", "tables", "out")
    return top


def run(spark: SparkSession, given: argparse.Namespace) -> None:
    resume = not given.no_resume
    if given.command == "process":
        if given.stage in ("embedding", "all"):
            jobs.chunk(spark, given.corpus, given.out)
            jobs.embed(spark, given.out, resume)
        if given.stage in ("index", "all"):
            jobs.build_index(spark, given.out)
        if given.stage in ("graph", "all"):
            jobs.extract(spark, given.out, resume)
            jobs.build_graph(spark, given.out)
    elif given.command == "retrieve":
        jobs.retrieve(spark, given.method, given.out, given.questions, resume, base=given.retriever_type)
    elif given.command == "retry":
        jobs.retry(spark, given.method, given.out, given.questions)
    elif given.command == "evaluate" and given.what in ("result", "labels"):
        method, out, questions = given.rest
        jobs.evaluate_answers(spark, method, out, questions, resume, given.what == "labels", labels=not given.skip_llm, base=given.retriever_type)
    elif given.command == "evaluate":
        (out,) = given.rest
        jobs.evaluate_semantic(spark, out, given.hubness_k) if given.what == "semantic" else jobs.evaluate_structure(spark, out)
    elif given.command == "compare":
        jobs.compare(spark, given.first, given.second, given.out)
    elif given.command == "questions":
        if given.step in ("generate", "all"):
            jobs.generate_questions(spark, given.out, given.single_hop, given.multi_hop, given.summary, given.append)
        if given.step in ("validate", "all"):
            jobs.validate_questions(spark, given.out, resume)
        if given.step in ("filter", "all"):
            jobs.filter_questions(spark, given.out)
    elif given.command == "classify":
        jobs.classify(spark, given.out, given.questions, given.scheme)
    elif given.command == "pipeline":
        methods = jobs.METHODS if given.method == "all" else [given.method]
        jobs.pipeline(spark, given.corpus, given.questions, given.out, methods, given.skip_process, given.skip_eval, resume, not given.skip_llm, given.retriever_type)
    else:
        from . import plans

        plans.load()[0][given.name](spark, given.tables).write.mode("overwrite").parquet(given.out)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    run(SparkSession.builder.appName("lodestar").getOrCreate(), given)


if __name__ == "__main__":
    main()
