"""``python -m marlpit.cli``: list queries, run them, build the dataset, write reports."""

from __future__ import annotations

import argparse
import sys

from marlpit.plans import registry
from marlpit.session import get_session
from marlpit.sources import sinks

DATASET = ("master_interactions", "task_states_viewplus", "task_states_favoriteplus", "task_states_purchase", "candidates", "impressed_candidates")
#: Export packages: tables and documents of one experiment.
PACKAGES = {
    "popularity": (("eval_multi_k", "eval_popularity", "representation_stats", "signal_richness", "stability"), ("heavy_user", "signal_overlap", "best_baseline")),
    "mf_baseline": (("mf_train", "eval_mf", "comparison_table"), ("coverage", "confidence_stats")),
    "mf_bias": (("mf_bias", "item_train_counts", "comparison_table"), ("coverage",)),
    "mf_objective": (("mf_objective", "loss_values", "comparison_table"), ("coverage", "sampling_stats")),
    "mf_sampling": (("mf_sampling", "sampling_stats", "hardness"), ("coverage",)),
    "mf_latent_dim": (("mf_latent_dim",), ("coverage",)),
    "mf_representation": (("mf_representation", "representation_stats", "confidence_stats"), ("coverage",)),
    "mf_signal": (("mf_signal", "cart_signal_states", "signal_alignment"), ("coverage",)),
    "hybrid": (("eval_hybrid", "select_alpha", "score_decomposition", "fallback_groups", "backfill_groups", "history_groups", "popularity_groups", "comparison_table"), ("personalization",)),
}
REPORTS = {
    "dataset": ("split_summary", "state_distribution", "sparsity_user", "sparsity_item", "leakage_audit"),
    "popularity": ("eval_multi_k", "best_baseline", "stability", "signal_richness", "representation_stats", "signal_overlap", "activity_deciles"),
    "interactions": ("session_summary", "exposure_concentration", "continuity", "quartile_signal", "best_threshold"),
    "engagement": ("funnel_conversion", "funnel_by_group", "conversion_timing", "quartile_rates", "price_signal", "auc_single_feature", "purchase_concentration"),
    "catalog": ("catalog_stats", "corr_matrix", "decimal_percentile", "tag_counts"),
}


#: A result of more rows is stored as a table of its package, not as a document.
DOCUMENT_ROWS = 100


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlpit")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query"), run.add_argument("tables"), run.add_argument("--out"), run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    build = sub.add_parser("build-dataset")
    build.add_argument("tables"), build.add_argument("out")
    package = sub.add_parser("export")
    package.add_argument("name", choices=sorted(PACKAGES)), package.add_argument("tables"), package.add_argument("out")
    report = sub.add_parser("report")
    report.add_argument("name", choices=sorted(REPORTS)), report.add_argument("tables")
    args = p.parse_args(argv)
    queries = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.command == "run" and args.query not in queries:
        print(f"no query {args.query!r}", file=sys.stderr)
        return 2
    spark = get_session("marlpit-cli")
    if args.command == "run":
        df = queries[args.query](spark, args.tables)
        if args.out is None:
            df.show(50, truncate=False)
        elif args.format == "csv":
            sinks.csv_ready(df).write.mode("overwrite").option("header", True).csv(args.out)
        else:
            df.write.mode("overwrite").format(args.format).save(args.out)
    elif args.command == "build-dataset":
        print(sinks.write_dataset({n: queries[n](spark, args.tables) for n in DATASET}, args.out))
    elif args.command == "export":
        names, small = PACKAGES[args.name]
        frames = {n: queries[n](spark, args.tables) for n in (*names, *small)}
        heads = {n: frames[n].limit(DOCUMENT_ROWS + 1).collect() for n in small}
        documents = {n: {"rows": [r.asDict() for r in rows]} for n, rows in heads.items() if len(rows) <= DOCUMENT_ROWS}
        print(sinks.write_package({n: df for n, df in frames.items() if n not in documents}, documents, args.out))
    else:
        print("\n".join(sinks.markdown(queries[n](spark, args.tables), n) for n in REPORTS[args.name]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
