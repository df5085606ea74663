"""python -m evalanvil list | prompts | score | verify | compact | represent"""

from __future__ import annotations

import argparse

from evalanvil.plans import api
from evalanvil.plans.session import build_session
from evalanvil.sources import catalog


def main(argv: list[str] | None = None) -> int:
    """Runs one command; the exit code of verify is 1 unless every run is ok."""
    parser = argparse.ArgumentParser(prog="evalanvil")
    parser.add_argument("--root")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("prompts", "score", "verify", "compact", "represent"):
        c = commands.add_parser(name)
        c.add_argument("eval_id")
        c.add_argument("dataset")
        if name == "prompts":
            c.add_argument("path")
            c.add_argument("--limit", type=int, default=0)
        if name == "score":
            c.add_argument("completions")
            c.add_argument("--output")
        if name in ("verify", "compact", "represent"):
            c.add_argument("results")
        if name in ("compact", "represent"):
            c.add_argument("to")
            c.add_argument("--samples", type=int, default=200)
    a = parser.parse_args(argv)
    spark = build_session()
    if a.command == "list":
        catalog.list_evals(spark, a.root).show(truncate=False)
    elif a.command == "prompts":
        catalog.export_prompts(api.samples(spark, a.eval_id, a.dataset, a.root), a.path, a.limit)
    elif a.command == "score":
        scored, metrics = api.score_completions(spark, a.eval_id, a.dataset, catalog.read_completions(spark, a.completions), a.root)
        print(api.report(a.eval_id, a.dataset, scored, metrics).where("section = 'summary'").first()["entry"])
        if a.output:
            with open(a.output, "w", encoding="utf-8") as out:
                out.writelines(api.report_document(a.eval_id, a.dataset, scored, metrics))
    elif a.command == "verify":
        found = api.verify_runs(spark, a.eval_id, a.dataset, a.results, a.root)
        found.orderBy("model").show(200, truncate=False)
        return int(found.where("not ok").limit(1).count() > 0)
    elif a.command == "represent":
        print(api.representative_dataset(spark, a.eval_id, a.dataset, a.results, a.samples, a.to, a.root))
    else:
        print(api.compact_dataset(spark, a.eval_id, a.dataset, a.results, a.samples, a.to, a.root))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
