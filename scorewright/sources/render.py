"""A board as text, Markdown and HTML, from its small collected frames, and its utterances in files beside the page."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import board

MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}
DASH = "–"


def percent(rate: float | None) -> str:
    return DASH if rate is None else f"{100 * rate:.1f}%"


def factor(value: float | None) -> str:
    return DASH if not value else f"{value:.1f}"


def heading(dataset: str, ref_name: str, several: bool) -> str:
    """A column's heading: the reference, below its dataset where there are several of them."""
    return f"{dataset}\n{ref_name.upper()}" if several else ref_name.upper()


AVERAGE = ("", "")
KINDS = ("wer", "cer")
#: How near to a column's best a rate counts as it, and what stands for a missing one where rows are sorted.
NEAR, LAST = 1e-9, 1e9


class Board:
    """The collected rows of a board: its columns in order, its ranked models, and of each rate its value and its column's bounds.

    Columns are (dataset, reference), AVERAGE for the averages; each has a rate of each of KINDS, and bounds of its own.
    """

    def __init__(self, runs: DataFrame, exclude_failed: bool = False) -> None:
        named = board.named(runs)
        named = board.without_failed(named) if exclude_failed else named
        kept = board.latest(named)
        cells = board.cells(named, kept)
        ranked = board.leaderboard(runs, exclude_failed)
        self.columns = [(r["dataset"], r["ref_name"]) for r in board.columns(named, kept).orderBy("ordinal").collect()]
        self.rows = [r.asDict() for r in ranked.orderBy("rank").collect()]
        self.meta = [r.asDict() for r in board.dataset_meta(named, kept).orderBy("dataset").collect()]
        averages = ranked.select(F.col("model").alias("name"), F.lit("").alias("dataset"), F.lit("").alias("ref_name"), F.col("average_wer").alias("wer"), F.col("average_cer").alias("cer"))
        rated = cells.select("name", "dataset", "ref_name", "wer", "cer").unionByName(averages).select("name", "dataset", "ref_name", F.explode(F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(k))))).alias("kind", "rate"))
        bounds = board.column_bounds(rated, ("dataset", "ref_name", "kind"), "rate")
        shown = rated.where("rate is not null").join(bounds, ["dataset", "ref_name", "kind"]).withColumn("rgb", board.colour(F.col("rate"), F.col("vmin"), F.col("vmax")))
        shown = shown.select("name", "dataset", "ref_name", "kind", "rate", "rgb", board.text_colour(F.col("rgb")).alias("ink"), "vmin", "vmax")
        self.rates, self.bounds, self.least = {}, {}, {}
        for r in shown.collect():
            column = (r["dataset"], r["ref_name"]), r["kind"]
            self.rates[r["name"], *column] = r.asDict(recursive=True)
            self.bounds[column] = r["vmin"], r["vmax"]
            self.least[column] = min(r["rate"], self.least.get(column, r["rate"]))

    def rate(self, model: str, column: tuple[str, str], kind: str) -> float | None:
        own = self.rates.get((model, column, kind))
        return own and own["rate"]

    def is_best(self, model: str, column: tuple[str, str], kind: str) -> bool:
        """Whether a rate is its column's best, by its value and not by how it is written."""
        rate = self.rate(model, column, kind)
        return rate is not None and abs(rate - self.least[column, kind]) < NEAR

    def rate_columns(self) -> list[tuple[str, tuple[str, str], str]]:
        """(heading, column, kind) of all rates in their order."""
        several = len({d for d, _ in self.columns}) > 1
        heads = [*((heading(d, r, several).replace("\n", " "), (d, r)) for d, r in self.columns), ("Avg", AVERAGE)]
        return [(f"{head} {kind.upper()}", column, kind) for head, column in heads for kind in KINDS]

    def table(self, mark: Callable[[str], str] = str) -> list[list[str]]:
        """The board as text, its headings first; ``mark`` is put on the best of each column."""
        columns = self.rate_columns()
        out = [["#", "Model", *(head for head, _, _ in columns), "RTFx"]]
        for row in self.rows:
            rates = [(mark if self.is_best(row["model"], c, k) else str)(percent(self.rate(row["model"], c, k))) for _, c, k in columns]
            out.append([str(row["rank"]), row["model"], *rates, factor(row["rtfx"])])
        return out

    def bars(self, column: tuple[str, str], kind: str = "wer") -> list[tuple[str, str, float | None]]:
        """(label, model, rate) of a column's bars, the best first and models without a rate last; a label tells the place and the model."""
        each = [(r["model"], self.rate(r["model"], column, kind)) for r in self.rows]
        each.sort(key=lambda x: LAST if x[1] is None else x[1])
        return [(f"{k}. {model}", model, rate) for k, (model, rate) in enumerate(each, 1)]


#: What begins and ends a style in a terminal (fixed values).
DIM, BOLD, PLAIN = "\x1b[2m", "\x1b[1m", "\x1b[0m"


def style(own: dict[str, object] | None, best: bool) -> str:
    """What a rate is written in: dim if it is missing, else in its colour, and bold if it is its column's best."""
    if own is None:
        return DIM
    rgb = own["rgb"]
    return (BOLD if best else "") + f"\x1b[38;2;{rgb['r']};{rgb['g']};{rgb['b']}m"


def text(shown: Board, styled: bool = False) -> str:
    """A table for a terminal, its rates in their colours if ``styled``; a message where there is nothing to show."""
    rows, columns = shown.table(), shown.rate_columns()
    if len(rows) == 1:
        return "No results."
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    cells = [[c.ljust(w) if k == 1 else c.rjust(w) for k, (c, w) in enumerate(zip(r, widths, strict=True))] for r in rows]
    for row, own in zip(shown.rows, cells[1:], strict=True) if styled else ():
        for k, (_, column, kind) in enumerate(columns, 2):
            own[k] = style(shown.rates.get((row["model"], column, kind)), shown.is_best(row["model"], column, kind)) + own[k] + PLAIN
    return "\n".join("  ".join(r) for r in cells)


def markdown(shown: Board) -> str:
    """A Markdown table, the best of each column bold."""
    head, *rows = shown.table(lambda rate: f"**{rate}**")
    for r in rows:
        r[0] = MEDALS.get(int(r[0]), r[0])
    lines = [head, ["---"] * len(head), *rows]
    return "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in lines)


def payload(value: object) -> str:
    """JSON that can stand in a script element."""
    return json.dumps(value, ensure_ascii=False).replace("</", "<\\/")


#: What references are called beside an utterance, in the order in which they stand there (fixed values).
LABELS = {"ort": "ORT", "dialect": "TR2", "kan": "KAN"}


def labelled(references: Iterable[str]) -> list[tuple[str, str]]:
    """(name, label) of references: the known ones first, others after them as they come, under their own names."""
    given = [*dict.fromkeys(references)]
    return [(r, LABELS[r]) for r in LABELS if r in given] + [(r, r) for r in given if r not in LABELS]


def chip(meta: dict[str, object]) -> str:
    """What a dataset's board is made of, its primary reference starred."""
    facts = [f"{meta['samples']} samples", f"{meta['models']} models"]
    facts += [meta["language"]] if meta["language"] else []
    names = ", ".join(r + "★" if r == meta["primary"] else r for r in meta["references"])
    facts += [f"refs: {names}"] if names else []
    return f"{meta['dataset']}: {' · '.join(facts)}"


def _pill(own: dict[str, object]) -> str:
    rgb = own["rgb"]
    return f"background:rgb({rgb['r']},{rgb['g']},{rgb['b']});color:{own['ink']}"


def page(shown: Board, shards: list[dict[str, object]] | None = None) -> str:
    """A page of its own: the coloured table, bars for each column, what the corpora are, and links to the utterances' ``shards``.

    Every cell has what it sorts by, a missing one LAST. The data for scripts is the board's, and the index of the shards.
    """
    columns = shown.rate_columns()
    chips = "".join(f"<li>{html.escape(chip(m))}</li>" for m in shown.meta)
    head = "".join(f"<th>{html.escape(h)}</th>" for h in ("#", "Model", *(h for h, _, _ in columns), "RTFx"))
    body = []
    for row in shown.rows:
        cells = []
        for _, column, kind in columns:
            own = shown.rates.get((row["model"], column, kind))
            if own is None:
                cells.append(f"<td data-sort='{LAST:.0f}'>{DASH}</td>")
            else:
                strong = " class='best'" if shown.is_best(row["model"], column, kind) else ""
                cells.append(f"<td{strong} data-sort='{own['rate']:.6f}' style='{_pill(own)}'>{percent(own['rate'])}</td>")
        speed = f"<td data-sort='{row['rtfx'] or LAST:.6f}'>{factor(row['rtfx'])}</td>"
        body.append(f"<tr><td data-sort='{row['rank']}'>{MEDALS.get(row['rank'], row['rank'])}</td><td>{html.escape(row['model'])}</td>{''.join(cells)}{speed}</tr>")
    charts = []
    for name, column, kind in columns:
        top = max((rate for _, _, rate in shown.bars(column, kind) if rate is not None), default=0) or 1
        bars = "".join(
            f"<div class='bar'><span>{html.escape(label)}</span>" + (DASH if rate is None else f"<b style='width:{100 * rate / top:.1f}%;{_pill(shown.rates[model, column, kind])}'>{percent(rate)}</b>") + "</div>"
            for label, model, rate in shown.bars(column, kind)
        )
        charts.append(f"<details><summary>{html.escape(name)}</summary>{bars}</details>")
    links = "".join(f"<li><a href='{html.escape(str(x['file']))}'>{html.escape(str(x['dataset']))}: {x['first']} to {x['last']}</a></li>" for x in shards or ())
    data = payload({"rows": shown.rows, "columns": shown.columns, "bounds": [[*c, k, *b] for (c, k), b in sorted(shown.bounds.items())], "labels": labelled(r for _, r in shown.columns), "shards": shards or []})
    style = ".best{font-weight:bold}.bar b{display:inline-block;min-width:3em}"
    return f"<!doctype html><meta charset='utf-8'><title>Leaderboard</title><style>{style}</style><ul>{chips}</ul><table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>{''.join(charts)}<ul>{links}</ul><script type='application/json' id='data'>{data}</script>"


#: Utterances of a dataset in one shard.
SHARD = 1000


def shard_rows(kept: DataFrame, size: int = SHARD) -> DataFrame:
    """(dataset, shard, idx, truth, said): for each utterance its ground truth and what each run says, both as JSON.

    ``truth`` has speaker, duration and the references by name; ``said`` by run's name the hypothesis and
    for each reference the two rates at four places. The runs that say nothing of an utterance aren't in it.
    """
    truth = board.ground_truth(kept).groupBy("dataset", "idx").agg(F.first("speaker").alias("spk"), F.first("duration").alias("dur"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("ref_name").isNotNull(), F.struct("ref_name", "reference"))))).alias("refs"))
    rated = F.when(F.col("ref_name").isNotNull(), F.struct("ref_name", F.array("wer", "cer")))
    each = board.drill_down(kept).groupBy("dataset", "idx", "name").agg(F.first("hypothesis").alias("hyp"), F.sort_array(F.collect_list(rated)).alias("m"))
    said = each.groupBy("dataset", "idx").agg(F.sort_array(F.collect_list(F.struct("name", "hyp", "m"))).alias("said"))
    by_name = F.map_from_entries(F.transform("said", lambda x: F.struct(x["name"], F.struct(x["hyp"].alias("hyp"), F.map_from_entries(x["m"]).alias("m")))))
    out = truth.join(said, ["dataset", "idx"])
    return out.select("dataset", F.floor(F.col("idx") / size).alias("shard"), "idx", F.to_json(F.struct("spk", "dur", "refs"), {"ignoreNullFields": "false"}).alias("truth"), F.to_json(by_name).alias("said"))


def write_shards(kept: DataFrame, folder: str, size: int = SHARD) -> list[dict[str, object]]:
    """Writes the utterances of each dataset to files of ``size`` of them, each by the task that has it; the index of the files.

    A file appears whole or not at all. What comes to the driver is a row for each file.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        from .migration import Folder

        frame, place = frame.sort_values("idx"), Folder(folder)
        name = f"utterances/{quote(str(frame['dataset'].iloc[0]), safe='')}-{int(frame['shard'].iloc[0])}.json"
        place.make("utterances")
        entries = (f'"{i}":{{"truth":{t},"said":{s}}}' for i, t, s in zip(frame["idx"], frame["truth"], frame["said"], strict=True))
        place.write(name, ("{" + ",".join(entries) + "}").encode())
        return pd.DataFrame({"dataset": [frame["dataset"].iloc[0]], "first": [frame["idx"].iloc[0]], "last": [frame["idx"].iloc[-1]], "file": [name], "n": [len(frame)]})

    rows = shard_rows(kept, size).groupBy("dataset", "shard").applyInPandas(write, "dataset string, first long, last long, file string, n long")
    return [r.asDict() for r in rows.orderBy("dataset", "first").collect()]


def write_page(runs: DataFrame, folder: str, exclude_failed: bool = False, size: int = SHARD) -> list[dict[str, object]]:
    """The page and the shards that it links to, under ``folder``; the index of the shards. Only the board's rows are collected."""
    from .migration import Folder

    named = board.named(runs)
    kept = board.latest(board.without_failed(named) if exclude_failed else named)
    shards = write_shards(kept, folder, size)
    place = Folder(folder)
    place.make("")
    place.write("index.html", page(Board(runs, exclude_failed), shards).encode())
    return shards


def summary(reference_metrics: DataFrame, speed: DataFrame | None = None) -> str:
    """Rates of each reference at two places, and the speed where it is known."""
    lines = [f"{r['ref_name']}: WER {100 * r['wer']:.2f} %, CER {100 * r['cer']:.2f} %" for r in reference_metrics.orderBy("ref_name").collect()]
    for r in speed.collect() if speed is not None else ():
        lines.append(f"RTFx {r['rtfx']:.2f}")
    return "\n".join(lines)
