"""python -m basketlab JOB FOLDER ... : run one batch job, see ``basketlab.plans.jobs``."""

from __future__ import annotations

import argparse

from basketlab.plans import jobs
from basketlab.session import build


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="basketlab")
    sub = parser.add_subparsers(dest="job", required=True)

    def job(name: str, folders: list[str], **options: float | int) -> None:
        p = sub.add_parser(name)
        for folder in folders:
            p.add_argument(folder)
        for option, default in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", type=type(default), default=default)

    job("load", ["csv_folder", "out"])
    job("clean_orders", ["folder", "out"])
    job("segment_users", ["folder", "out"], k=4, n_init=10, fraction=1.0)
    job("train_rules", ["folder", "cleaned", "out"], min_support=0.05, min_lift=1.0)
    job(
        "train_segment_rules", ["folder", "cleaned", "segments", "out"], min_support=0.01, min_lift=1.5
    )
    job("train_svd", ["folder", "cleaned", "out"], n_components=80)
    job("train_segment_svd", ["folder", "cleaned", "segments", "out"], n_components=50)
    args = vars(parser.parse_args(argv))
    report = getattr(jobs, args.pop("job"))(build(), **args)
    if report is not None:
        report.show()


if __name__ == "__main__":
    main()
