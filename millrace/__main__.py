"""Run one job: `python -m millrace JOB --schema NAME [--run-date DAY] [--phase PHASE] [--feed PATH]`."""

from __future__ import annotations

import argparse
import inspect
from datetime import date

from pyspark.sql import SparkSession

from millrace.checks.suite import PHASES
from millrace.jobs import JOBS
from millrace.jobs.base import Store


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--schema", required=True, help="schema of the tables read and written")
    parser.add_argument("--run-date", type=date.fromisoformat, help="day to process")
    parser.add_argument("--as-of", type=date.fromisoformat, help="reporting day of billing reports")
    parser.add_argument("--phase", choices=PHASES, help="check published tables by their contracts of this phase")
    parser.add_argument("--feed", help="path of the delivered feed")
    options = parser.parse_args(arguments)
    job = JOBS[options.job]
    accepted = inspect.signature(job).parameters
    given = {"run_date": options.run_date, "as_of": options.as_of, "feed": options.feed}
    values = {k: v for k, v in given.items() if k in accepted and v is not None}
    for name in ("run_date", "feed"):
        if name in accepted and name not in values:
            parser.error(f"{options.job} needs --{name.replace('_', '-')}")
    job(Store(SparkSession.builder.getOrCreate(), options.schema, options.phase), **values)


if __name__ == "__main__":
    main()
