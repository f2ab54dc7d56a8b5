"""Command line: python -m calypile.cli parse-bam | plot-browser | plot-enrichment | plot-enrichment-profile | qc-report.

Installed, each is a command of its own: calypile-parse-bam and so on.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from calypile import api
from calypile.session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="calypile", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, many: bool) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        more = {"nargs": "+"} if many else {}
        c.add_argument("-f", "--files", required=True, help="BAM or SAM files", **more)
        c.add_argument("-s", "--samples", required=True, help="sample names, one for each file", **more)
        c.add_argument("-o", "--out-dir", required=True)
        c.add_argument("-p", "--cores", type=int, default=None, help="local cores (default: all); a cluster's are set by spark-submit")
        return c

    def colors(c: argparse.ArgumentParser, families: bool = True, many: bool = True, dot: float | None = None) -> None:
        if families:
            c.add_argument("--colorA", dest="color_a", default=None, help="colour of adenine calls")
            c.add_argument("--colorC", dest="color_c", default=None, help="colour of cytosine calls")
        if many:
            c.add_argument("--colors", nargs="+", default=None, help="colours in turn")
        if dot is not None:
            c.add_argument("-d", "--dotsize", dest="dot_size", type=float, default=dot)

    def thresholds(c: argparse.ArgumentParser) -> None:
        c.add_argument("-A", "--thresh-a", type=int, default=129)
        c.add_argument("-C", "--thresh-c", type=int, default=129)

    c = command("parse-bam", False)
    where = c.add_mutually_exclusive_group(required=True)
    where.add_argument("-b", "--bed-file")
    where.add_argument("-r", "--region")
    c.add_argument("-m", "--basemod", default="A+CG", choices=["A", "CG", "A+CG"])
    thresholds(c)
    c.add_argument("-e", "--extract-all-bases", action="store_true")
    c.add_argument("-c", "--center", action="store_true")
    c.add_argument("-w", "--window-size", type=int, default=1000)

    c = command("plot-browser", True)
    c.add_argument("-r", "--region", required=True)
    c.add_argument("-m", "--basemod", default="A+CG", choices=["A", "CG", "A+CG"])
    thresholds(c)
    c.add_argument("-b", "--bed-features", nargs="+", default=None)
    c.add_argument("-t", "--smooth", type=int, default=1000)
    c.add_argument("-n", "--min-periods", type=int, default=100)
    c.add_argument("--static", action="store_true", help="one SVG image instead of a page")
    colors(c, many=False, dot=4)

    c = command("plot-enrichment", True)
    c.add_argument("-b", "--bed-files", nargs="+", required=True)
    c.add_argument("-m", "--basemod", required=True, choices=["A", "CG"])
    thresholds(c)
    colors(c, families=False)

    c = command("plot-enrichment-profile", True)
    c.add_argument("-b", "--bed-files", nargs="+", required=True)
    c.add_argument("-m", "--basemod", default="A+CG", choices=["A", "CG", "A+CG"])
    thresholds(c)
    c.add_argument("-w", "--window-size", type=int, default=1000)
    c.add_argument("-t", "--smooth", type=int, default=50)
    c.add_argument("-n", "--min-periods", type=int, default=10)
    colors(c, dot=0.5)

    c = command("qc-report", True)
    c.add_argument("--primary-only", action="store_true")
    colors(c, families=False)
    return p


def main(argv: list[str] | None = None) -> dict:
    options = vars(parser().parse_args(argv))
    name, cores = options.pop("command"), options.pop("cores")
    if name == "parse-bam":
        options["file"], options["sample"] = options.pop("files"), options.pop("samples")
    spark = get_spark(f"calypile {name}", cores)
    report = getattr(api, name.replace("-", "_"))(spark, **options)
    print(json.dumps(report["manifest"], indent=1))
    return report["manifest"]


def _installed(name: str) -> Callable[[], None]:
    def run() -> None:
        main([name, *sys.argv[1:]])

    return run


parse_bam, plot_browser, plot_enrichment, plot_enrichment_profile, qc_report = map(_installed, ("parse-bam", "plot-browser", "plot-enrichment", "plot-enrichment-profile", "qc-report"))


if __name__ == "__main__":
    main()
