"""Command line: load exports, report, train, recommend."""

from __future__ import annotations

import argparse

from retailflow.operators import train as T
from retailflow.operators.interactions import Config
from retailflow.plans import ingest, reports
from retailflow.session import get_session
from retailflow.sources import tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="retailflow", description=__doc__)
    p.add_argument("--tables", required=True, help="folder of the processed tables")
    p.add_argument("--artifacts", help="folder of the trained models")
    p.add_argument("--load", nargs=2, metavar=("KIND", "PATH"), help="load a raw export")
    p.add_argument("--mode", choices=("replace", "append"), default="replace")
    p.add_argument("--lines", action="store_true", help="no cell of the export holds a line feed: read it once")
    p.add_argument("--encoding", help="charset of the export, instead of the detected one")
    p.add_argument("--report", choices=tuple(reports.REPORTS))
    p.add_argument("--selection", action="store_true", help="report on the selection")
    p.add_argument("--status", action="store_true", help="which tables there are")
    p.add_argument("--train", action="store_true")
    p.add_argument("--recommend", metavar="ID")
    p.add_argument("--k", type=int, default=20)
    p.add_argument("--model", choices=("ease", "bprmf"), default="ease")
    a = p.parse_args(argv)
    if (a.train or a.recommend) and not a.artifacts:
        p.error("--artifacts is needed")
    spark = get_session()
    if a.load:
        ingest.load(spark, a.load[1], a.load[0], a.tables, a.mode, a.encoding, multiline=not a.lines)
    if a.status:
        tables.status(spark, a.tables).show(truncate=False)
    if a.report:
        print(reports.as_text(reports.report(spark, a.tables, a.report, a.selection)))
    if a.train:
        T.train(spark, a.tables, a.artifacts, Config(top_k=a.k)).show(100, truncate=False)
    if a.recommend:
        rows = T.recommend(spark, a.tables, a.artifacts, a.recommend, a.k, a.model).collect()
        print("\n".join(f"{r.rank}. {r.site_name} ({r.item}) {r.score:.4f}" for r in rows) or "no history for this customer")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
