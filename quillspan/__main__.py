"""Command line: python -m quillspan parse|optimize|run|relink|status ..."""

from __future__ import annotations

import argparse

from quillspan.plans import pipeline
from quillspan.session import build_session, clean_scratch, ship


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspan")
    p.add_argument("action", choices=("parse", "optimize", "run", "relink", "status"))
    p.add_argument("--input", help="a file or a folder of files")
    p.add_argument("--vault", help="the folder of existing notes")
    p.add_argument("--out", help="the folder of new notes")
    p.add_argument("--manifest", help="the folder of the saved manifest: its newest version is read, a run writes the next")
    p.add_argument("--archive", help="the folder that a run moves its inputs to")
    p.add_argument("--config", help="a YAML file of settings")
    p.add_argument("--run-date", default="1970-01-01")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    over = {"run_date": a.run_date, "dry_run": a.dry_run, "force": a.force, "manifest_dir": a.manifest, "archive_dir": a.archive}
    settings = pipeline.Settings.from_config(a.config, **over) if a.config else pipeline.Settings(**over)
    spark = build_session()
    ship(spark)
    if a.action == "parse":
        for r in pipeline.parse_only(spark, a.input).toLocalIterator():
            print(r.json)
    elif a.action == "optimize":
        for df in pipeline.optimize_only(spark, a.input, settings)[1:]:
            df.show(1000, False)
    elif a.action == "status":
        from quillspan.operators.manifest import status
        from quillspan.sources.sinks import latest_manifest

        saved, _ = latest_manifest(spark, a.manifest)
        if saved is None:
            print("no manifest is saved there")
        else:
            status(saved).show(1, False)
    elif a.action == "relink":
        pipeline.relink(spark, a.vault, settings).show(1000, False)
    else:
        for name, df in pipeline.full(spark, a.input, a.vault, a.out, settings=settings).items():
            print(name)
            df.show(20, 80)
    clean_scratch(spark)


if __name__ == "__main__":
    main()
