"""Figure data as files: each result as JSON lines written by Spark, and one page with plots of all rows, drawn pixel by pixel as SVG.

A plot is a tuple: (frame, x, y, class) or ("dots", frame, x, y, class) for points, ("line", frame, x, y, class) for a curve of each class,
("spans", frame, x0, x1, y) for horizontal lines, ("bars", frame, label, value, class) for one bar a row. Rows are reduced to the plot's
pixels by an aggregation before they are fetched; bars are a row each and meant for small results.
"""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The size of a plot in pixels.
WIDTH, HEIGHT, MARGIN = 900, 260, 10
#: Colours of the classes in turn where none is given, and those of the two modifications.
COLORS = ["#053c5e", "#bb4430", "#2a6fbb", "#7ca982", "#e0a458", "#6b4e71", "#3d8b7d", "#a23b72", "#5c6b73"]
FAMILIES = {"A": "#053c5e", "C": "#bb4430"}


def write_data(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """A manifest: the folder of JSON lines of each frame, compressed."""
    out = {}
    for name, df in frames.items():
        out[name] = os.path.join(folder, name)
        df.write.mode("overwrite").json(out[name], compression="gzip")
    return out


def _plain(df: DataFrame, **columns: str) -> DataFrame:
    """The numeric columns as double under new names, without rows in which one is null or NaN; c is the class as text."""
    numbers = [n for n in columns if n != "c"]
    have = F.lit(True)
    for n in numbers:
        have = have & F.col(n).isNotNull() & ~F.isnan(n)
    cls = [F.col(columns["c"]).cast("string").alias("c")] if "c" in columns else [F.lit("").alias("c")]
    return df.select(*[F.col(columns[n]).cast("double").alias(n) for n in numbers], *cls).where(have)


def _scaled(x: str, low: float, high: float, size: int):
    return F.round((F.col(x) - low) * ((size - 2 * MARGIN) / ((high - low) or 1))).cast("int")


def _dots(df: DataFrame, x: str, y: str, cls: str, dot: float) -> tuple[str, list[str], str]:
    points = _plain(df, x=x, y=y, c=cls)
    x0, x1, y0, y1, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not n:
        return "", [], ""
    pixels = sorted((r[0], r[1], str(r[2])) for r in points.select(_scaled("x", x0, x1, WIDTH), _scaled("y", y0, y1, HEIGHT), "c").distinct().collect())
    drawn = "".join(f'<circle cx="{MARGIN + a}" cy="{HEIGHT - MARGIN - b}" r="{dot:g}" class="{html.escape(c)}"/>' for a, b, c in pixels)
    return drawn, [c for *_, c in pixels], f"{n} points, {x0:g} to {x1:g}, {y0:g} to {y1:g}"


def _line(df: DataFrame, x: str, y: str, cls: str) -> tuple[str, list[str], str]:
    """A curve for each class through the mean of its values in each column of pixels."""
    points = _plain(df, x=x, y=y, c=cls)
    x0, x1, n = points.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return "", [], ""
    columns = sorted((str(r[0]), r[1], r[2]) for r in points.groupBy("c", _scaled("x", x0, x1, WIDTH).alias("p")).agg(F.avg("y")).collect())
    y0, y1 = min(v for *_, v in columns), max(v for *_, v in columns)
    up = lambda v: HEIGHT - MARGIN - round((v - y0) * ((HEIGHT - 2 * MARGIN) / ((y1 - y0) or 1)))
    classes = sorted({c for c, *_ in columns})
    drawn = "".join(f'<polyline class="{html.escape(k)}" points="{" ".join(f"{MARGIN + p},{up(v)}" for c, p, v in columns if c == k)}"/>' for k in classes)
    return drawn, classes, f"{n} points, {x0:g} to {x1:g}, {y0:g} to {y1:g}"


def _spans(df: DataFrame, x0: str, x1: str, y: str) -> tuple[str, list[str], str]:
    """Horizontal lines as the runs of pixels they cover."""
    rows = _plain(df, a=x0, b=x1, y=y)
    low, high, y0, y1, n = rows.agg(F.min("a"), F.max("b"), F.min("y"), F.max("y"), F.count("*")).first()
    if not n:
        return "", [], ""
    covered = rows.select(_scaled("y", y0, y1, HEIGHT).alias("y"), F.explode(F.sequence(_scaled("a", low, high, WIDTH), _scaled("b", low, high, WIDTH))).alias("x")).distinct()
    runs: list[list[int]] = []
    for at, x in sorted((r["y"], r["x"]) for r in covered.collect()):
        if runs and runs[-1][0] == at and runs[-1][2] == x - 1:
            runs[-1][2] = x
        else:
            runs.append([at, x, x])
    drawn = "".join(f'<line x1="{MARGIN + a}" x2="{MARGIN + b + 1}" y1="{HEIGHT - MARGIN - at}" y2="{HEIGHT - MARGIN - at}"/>' for at, a, b in runs)
    return drawn, [], f"{n} lines, {low:g} to {high:g}, {y0:g} to {y1:g}"


def _bars(df: DataFrame, label: str, value: str, cls: str) -> tuple[str, list[str], str]:
    rows = sorted((str(r[0]), float(r[1]), str(r[2])) for r in df.select(label, value, cls).toLocalIterator() if r[1] is not None)
    if not rows:
        return "", [], ""
    top, step = max(max(v for _, v, _ in rows), 0) or 1.0, (WIDTH - 2 * MARGIN) / len(rows)
    drawn = ""
    for i, (name, v, c) in enumerate(rows):
        high = round(max(v, 0) / top * (HEIGHT - 2 * MARGIN - 12))
        drawn += f'<rect x="{MARGIN + i * step:.1f}" y="{HEIGHT - MARGIN - high}" width="{step * 0.8:.1f}" height="{high}" class="{html.escape(c)}"><title>{html.escape(name)} {v:g}</title></rect>'
        drawn += f'<text x="{MARGIN + i * step:.1f}" y="{HEIGHT - MARGIN - high - 2}">{html.escape(name)} {v:.3g}</text>'
    return drawn, [c for *_, c in rows], f"{len(rows)} bars, 0 to {top:g}"


def _plot(plot: tuple, dot: float) -> tuple[str, list[str], str]:
    kind, *rest = plot if isinstance(plot[0], str) else ("dots", *plot)
    if kind == "dots":
        return _dots(*rest, dot)
    return {"line": _line, "spans": _spans, "bars": _bars}[kind](*rest)


def _style(classes: Iterable[str], colors: dict[str, str] | list[str] | None) -> str:
    """A colour for each class: as given by name, or in turn."""
    named = FAMILIES | colors if isinstance(colors, dict) else FAMILIES if colors is None else {}
    turn = colors if isinstance(colors, list) and colors else COLORS
    paint = {c: named.get(c, turn[i % len(turn)]) for i, c in enumerate(dict.fromkeys(sorted(classes)))}
    rules = "".join(f"[class='{html.escape(c)}']{{fill:{x};stroke:{x}}}" for c, x in paint.items())
    return f"circle,rect{{stroke:none!important}}polyline{{fill:none!important}}line{{stroke:#999}}text{{font-size:9px;stroke:none}}td,th{{padding:2px 8px}}{rules}"


def write_page(path: str, title: str, plots: dict[str, tuple], tables: dict[str, DataFrame], colors: dict[str, str] | list[str] | None = None, dot: float = 1.5, static: bool = False) -> str:
    """A page of plots and tables of all rows; static: one SVG image of the plots alone, its name ending in .svg."""
    drawn = {name: _plot(plot, dot) for name, plot in plots.items()}
    style = _style([c for _, classes, _ in drawn.values() for c in classes], colors)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if static:
        path, body = os.path.splitext(path)[0] + ".svg", ""
        for i, (name, (shapes, _, note)) in enumerate(drawn.items()):
            body += f'<g transform="translate(0,{i * (HEIGHT + 30)})"><text x="10" y="10">{html.escape(name)}: {html.escape(note or "no data")}</text><g transform="translate(0,15)">{shapes}</g></g>'
        with open(path, "w", encoding="utf-8") as f:
            f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{max(len(drawn), 1) * (HEIGHT + 30)}"><style>{style}</style>{body}</svg>')
        return path
    body = f"<h1>{html.escape(title)}</h1>"
    for name, (shapes, classes, note) in drawn.items():
        key = " ".join(f'<span class="{html.escape(c)}">{html.escape(c)}</span>' for c in dict.fromkeys(sorted(classes)))
        body += f"<h2>{html.escape(name)}</h2>" + (f'<svg viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" height="{HEIGHT}">{shapes}</svg><p>{note} <i>{key.replace("<span class=", "<span title=")}</i></p>' if note else "<p>no data</p>")
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        lines = "".join("<tr>" + "".join(f"<td>{html.escape(json.dumps(v, default=str))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
        body += f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{lines}</table>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><style>{style}</style>{body}")
    return path
