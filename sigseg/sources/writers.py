"""Signals and segmentations as text, and descriptions of models and tracks."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigseg.operators.hmm import HmmModel
from sigseg.operators.signal import runs

#: Colours of states in BED files, repeated beyond.
COLORS = ["128,128,128", "0,128,0", "200,0,0", "0,0,200", "200,128,0", "128,0,128"]

#: Positions of a wig file below one header.
WIG_SPREAD = 1 << 16


def bedgraph_rows(signal: DataFrame, bin_size: int, decimals: int = 3) -> DataFrame:
    """chrom, start, end, score: runs of equal rounded values, half-open."""
    cut = runs(signal.select("chrom", "bin", (F.round("value", decimals) + 0.0).alias("state")))
    return cut.select("chrom", (F.col("start") * bin_size).alias("start"), ((F.col("start") + F.col("length")) * bin_size).alias("end"), F.col("state").alias("score"))


def bed9_rows(segmentation: DataFrame, bin_size: int, names: list[str] | None = None) -> DataFrame:
    """The nine BED columns of the runs of a segmentation, coloured by state."""
    cut = runs(segmentation)
    start, end = F.col("start") * bin_size, (F.col("start") + F.col("length")) * bin_size
    name = F.element_at(F.array(*map(F.lit, names)), F.col("state") + 1) if names else F.col("state").cast("string")
    color = F.element_at(F.array(*map(F.lit, COLORS)), F.col("state") % len(COLORS) + 1)
    cells = [("chrom", F.col("chrom")), ("start", start), ("end", end), ("name", name), ("score", F.lit(0)), ("strand", F.lit(".")), ("thick_start", start), ("thick_end", end), ("color", color)]
    return cut.select(*[c.alias(n) for n, c in cells])


def write_tsv(rows: DataFrame, path: str, order: tuple[str, ...] = ("chrom", "start")) -> None:
    """Tab-separated files, sorted over all files."""
    rows.orderBy(*order).write.mode("error").csv(path, sep="\t")


def write_wig(steps: DataFrame, path: str, span: int) -> None:
    """Steps (chrom, start, score) as variableStep wig files.

    Each WIG_SPREAD positions of a chromosome have a header of their own, in one
    row with their first step: no plan can part the two, and a chromosome is
    written by many tasks.
    """
    block = Window.partitionBy("chrom", F.expr(f"start div {WIG_SPREAD}")).orderBy("start")
    line = F.concat_ws(" ", F.col("start") + 1, "score")
    header = F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={span}"))
    text = F.when(F.row_number().over(block) == 1, F.concat_ws("\n", header, line)).otherwise(line)
    steps.select(text.alias("value")).write.text(path)


def model_summary(model: HmmModel) -> list[tuple[int, str, float]]:
    """(state, what, value) rows of starts, transitions and, if any, end weights."""
    rows = [(i, "start", float(p)) for i, p in enumerate(model.start)]
    rows += [(i, f"to {j}", float(p)) for i, row in enumerate(model.transition) for j, p in enumerate(row)]
    return rows + [(i, "end", float(p)) for i, p in enumerate(model.end or [])]


def heatmap_html(rows: list[list[float]], row_names: list[str], column_names: list[str]) -> str:
    """A small table whose cells are shaded by value."""
    flat = [v for row in rows for v in row]
    low, high = min(flat, default=0), max(flat, default=1)
    shade = lambda v: int(255 - 155 * (v - low) / ((high - low) or 1))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in column_names)
    body = "".join(f"<tr><th>{html.escape(n)}</th>" + "".join(f'<td style="background:rgb(255,{shade(v)},{shade(v)})">{v:.3g}</td>' for v in row) + "</tr>" for n, row in zip(row_names, rows, strict=True))
    return f"<table><tr><th></th>{head}</tr>{body}</table>"


def model_html(model: HmmModel) -> str:
    """Transitions and emission of a model."""
    states = [f"state {i}" for i in range(model.n_states)]
    return f"<h2>Transitions</h2>{heatmap_html(model.transition, states, states)}<h2>Emission</h2><pre>{html.escape(str(model.emission))}</pre>"


def state_colors(n_states: int) -> list[str]:
    """A colour for each state."""
    return [COLORS[i % len(COLORS)] for i in range(n_states)]


def states_html(model: HmmModel, names: list[str] | None = None) -> str:
    """A line for each state: name, colour, mean stay in bins and what it emits."""
    names = names or [f"state {i}" for i in range(model.n_states)]
    rows = []
    for i, (name, color) in enumerate(zip(names, state_colors(model.n_states), strict=True)):
        stay = model.transition[i][i]
        length = "endless" if stay >= 1 else f"{1 / (1 - stay):.3g}"
        emitted = {k: v[i] for k, v in vars(model.emission).items()}
        rows.append(f'<tr><td style="background:rgb({color})">{html.escape(name)}</td><td>{length}</td><td>{html.escape(str(emitted))}</td></tr>')
    return "<table><tr><th>State</th><th>Mean stay</th><th>Emission</th></tr>" + "".join(rows) + "</table>"


def html_list(items: list[str]) -> str:
    """A numbered list."""
    return "<ol>" + "".join(f"<li>{html.escape(x)}</li>" for x in items) + "</ol>"


def description_html(**sections: str) -> str:
    """Headed paragraphs, in the order given; those without text are left out."""
    return "".join(f"<h2>{html.escape(k.replace('_', ' ').capitalize())}</h2><p>{html.escape(v)}</p>" for k, v in sections.items() if v)


def model_readme(name: str, resolution: int, model: HmmModel, training: list[str], likelihoods: list[float]) -> str:
    """A plain description of a trained model."""
    steps = ", ".join(f"{x:.6g}" for x in likelihoods)
    return f"{name}\nresolution: {resolution}\ntrained on: {', '.join(training)}\nlog-likelihoods: {steps}\n{model}\n"


def track_stanza(name: str, kind: str, url: str, label: str, parent: str | None = None, **more: str) -> str:
    """One stanza of a track database."""
    fields = {"track": name, "type": kind, "bigDataUrl": url, "shortLabel": label[:17], "longLabel": label, **({"parent": parent} if parent else {}), **more}
    return "".join(f"{k} {v}\n" for k, v in fields.items()) + "\n"


def hub_files(hub: str, genome: str, email: str, stanzas: list[str]) -> dict[str, str]:
    """The three text files of a track hub, by name."""
    return {
        "hub.txt": f"hub {hub}\nshortLabel {hub[:17]}\nlongLabel {hub}\ngenomesFile genomes.txt\nemail {email}\n",
        "genomes.txt": f"genome {genome}\ntrackDb {genome}/trackDb.txt\n",
        f"{genome}/trackDb.txt": "".join(stanzas),
    }


def composite_tracks(metadata: DataFrame, parent: str, label: str, groups: list[str], url: str = "") -> DataFrame:
    """position, stanza: a composite track and its members, from rows with ``file`` and the ``groups`` to sort by.

    A member's group values go into its ``subGroups``; the parent's stanza lists all values of each.
    """
    spark = metadata.sparkSession
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("none")), r"[^A-Za-z0-9]+", "_")
    values = metadata.agg(*[F.concat_ws(" ", F.array_sort(F.collect_set(F.concat(clean(g), F.lit("="), clean(g))))).alias(g) for g in groups])  # distinct values of a few groups
    head = [F.lit(f"track {parent}\ncompositeTrack on\nshortLabel {label[:17]}\nlongLabel {label}\ntype bigWig\n")]
    head += [F.concat(F.lit(f"subGroup{i + 1} {g} {g} "), F.col(g), F.lit("\n")) for i, g in enumerate(groups)]
    top = values.select(F.lit("").alias("position"), F.concat(*head, F.lit("\n")).alias("stanza"))
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    inside = F.concat_ws(" ", *[F.concat(F.lit(f"{g}="), clean(g)) for g in groups])
    cells = [F.lit("    track "), name, F.lit(f"\n    parent {parent}\n    type bigWig\n    bigDataUrl {url}"), F.col("file"), F.lit("\n    shortLabel "), F.substring(name, 1, 17), F.lit("\n    longLabel "), F.concat_ws("|", *map(clean, groups), name), F.lit("\n    subGroups "), inside, F.lit("\n\n")]
    members = metadata.select(F.col("file").alias("position"), F.concat(*cells).alias("stanza"))
    return (top.unionByName(members) if metadata.limit(1).count() else spark.createDataFrame([], "position string, stanza string")).orderBy("position")
