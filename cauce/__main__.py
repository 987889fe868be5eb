"""Command line: run a composed job as a Spark application.

    spark-submit --py-files cauce.zip cauce/__main__.py churn --sf-dir DIR --out DIR
    python -m cauce procurement --sf-dir /root/testdata/sf0.01 --out /shared/out --master "local[8]"

The session comes from ``spark-submit`` (or a local one with ``--master``);
``spark.checkpoint.dir`` must name a shared folder on a cluster.  Exit code
0 on success, 1 on failure (the reference's cron contract).
"""

from __future__ import annotations

import argparse
import sys
import traceback


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cauce")
    ap.add_argument("job", choices=["procurement", "churn", "sales"])
    ap.add_argument("--sf-dir", required=True, help="folder with the input Parquet tables")
    ap.add_argument("--out", required=True, help="output folder (shared filesystem on a cluster)")
    ap.add_argument("--run-id", default=None)
    ap.add_argument("--master", default=None, help="only for local runs")
    ap.add_argument("--grid", action="store_true", help="churn: also tune the forest by grid search")
    ap.add_argument("--model-dir", default=None, help="procurement: output folder of the churn run whose model scores")
    a = ap.parse_args(argv)

    from cauce.plans import jobs as J
    from cauce.session import build_session, ensure_checkpoint_dir

    spark = build_session(a.master, app_name=f"cauce-{a.job}")
    try:
        ensure_checkpoint_dir(spark, local_fallback=bool(a.master and a.master.startswith("local")))
        if a.job == "procurement":
            out = J.run_procurement(spark, a.sf_dir, a.out, a.run_id, model_dir=a.model_dir)
        elif a.job == "churn":
            out = J.run_churn(spark, a.sf_dir, a.out, a.run_id, with_grid=a.grid)
        else:
            out = J.run_sales(spark, a.sf_dir, a.out, a.run_id)
        out.show(truncate=False)
        return 0
    except Exception:  # noqa: BLE001 - report and signal failure to the scheduler
        traceback.print_exc()
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
