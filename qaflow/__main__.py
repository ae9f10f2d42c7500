"""``python -m qaflow JOB --flag value ...``: runs a job of ``qaflow.jobs`` and prints its table."""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import MISSING, fields
from typing import get_type_hints

from qaflow.jobs import JOBS
from qaflow.session import build_session


def parser() -> argparse.ArgumentParser:
    """A subcommand for each job, a flag for each field of its configuration; fields without a default are required."""
    top = argparse.ArgumentParser(prog="qaflow")
    sub = top.add_subparsers(dest="job", required=True)
    for name, (config, run, asks) in JOBS.items():
        one = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for f in fields(config):
            kind = get_type_hints(config)[f.name]
            needed = f.default is MISSING and f.default_factory is MISSING
            how = {bool: {"action": argparse.BooleanOptionalAction}, list[str]: {"nargs": "+"}, dict[str, str]: {"type": json.loads}}.get(kind, {"type": kind})
            one.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, required=needed, default=argparse.SUPPRESS, **how)
        if asks:
            one.add_argument("--provider", default="qaflow.streaming.inference:stub_provider", help="module:function that makes the model's function")
    return top


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    config, run, asks = JOBS[given.pop("job")]
    more = []
    if asks:
        module, _, name = given.pop("provider").partition(":")
        more.append(getattr(importlib.import_module(module), name))
    run(build_session(), config(**given), *more).show(100, truncate=False)


if __name__ == "__main__":
    main()
