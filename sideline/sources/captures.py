"""Captured text to tables: roster pages, tabular rosters, HTML tables, matchup sheets.

A capture is one row (``source_file``, ``value``). It is taken apart with
regular expressions inside the row, so parsing needs no shuffle, no Python and
no window, however many files there are; whole texts are processed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.functions.numeric import points_cell
from sideline.functions.text import (
    clean_text, compact_key, fold_ascii, fold_compatibility, inline_status, name_key, strip_labels, strip_labels_and_status, team_code,
)
from sideline.operators.reconcile import coverage_summary, reconcile
from sideline.operators.schema import resolve_aliases
from sideline.schemas import PARSER_VERSION, ROSTER_ALIASES, ROSTER_COLUMNS
from sideline.session import stored

# fixed values
SLOTS = "QB|RB|WR|TE|K|DEF|D/ST|DST|W/R/T|W/R|BN|BENCH|IR"
TEAM_LINE = r"[A-Za-z]{2,3}\s*-\s*(?:QB|RB|WR|TE|K|DEF|D/ST|DST)"
GLYPH = r"[\x{E000}-\x{F8FF}]"
SHEET_HEADER = "Stats\nPlayer\nProj\nFan Pts\nPos\nFan Pts\nProj\nPlayer\nStats\n"
STARTER_SLOTS = ("DEF", "K", "QB", "RB", "RB", "TE", "W/R/T", "WR", "WR")
MIN_CAPTURE_CHARS = 80
MIN_CAPTURE_ROWS = 8
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), "value"
    )


def _lines(text: Column) -> Column:
    """Stripped, non-blank lines."""
    trimmed = F.transform(
        F.split(F.regexp_replace(text, r"^\x{FEFF}", ""), LINE_BREAKS),
        lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""),
    )
    return F.filter(trimmed, lambda line: line != "")


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps use many times.

    Plain columns would be written out again wherever a later filter mentions
    them, and each mention would repeat the regular expression. Rows made by a
    generator are computed once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ------------------------------------------------------------ plausibility


def roster_line_count(text: Column) -> Column:
    return F.size(
        F.regexp_extract_all(text, F.lit(r"(?mi)^([A-Z]{2,4})\s*-\s*(?:QB|RB|WR|TE|K|DEF)\s*$"), F.lit(1))
    )


def is_roster_capture(text: Column) -> Column:
    """Long enough, and with enough TEAM - POS lines to be a roster and not a shell page."""
    cleaned = F.trim(F.regexp_replace(text, r"(?m)[ \t]+$", ""))
    return (F.length(cleaned) >= MIN_CAPTURE_CHARS) & (roster_line_count(text) >= MIN_CAPTURE_ROWS)


def is_matchup_capture(text: Column) -> Column:
    rows = F.size(F.regexp_extract_all(text, F.lit(r" - (?:QB|RB|WR|TE|K|DEF)"), F.lit(0)))
    return text.contains("Proj") & text.contains("Fan Pts") & (rows >= MIN_CAPTURE_ROWS)


# ------------------------------------------------------------ roster pages


def parse_roster_pages(captures: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Line-layout roster pages to rows.

    A manager heading ends with a private-use glyph. A slot line is followed by
    the name line, then "TEAM - POS" before the next slot or heading. The page
    is cut at headings, each part at slot lines; ``source_order`` keeps the
    page order.
    """
    # Folded as a whole, so its lines need no folding step of their own below.
    captures = captures.withColumn("value", fold_compatibility(F.col("value")))
    page = F.concat(F.array_join(F.transform(_lines(F.col("value")), lambda x: clean_text(x, ascii_only=True)), "\n"), F.lit("\n"))
    heading = rf"(?m)^(?:[^\n]*{GLYPH}\s*)$\n?"
    slot = rf"(?i:{SLOTS})"
    block = (
        rf"(?m)^({slot})\n"
        rf"((?:(?!(?:{slot})\n|[^\n]*{GLYPH})[^\n]*\n)*+)"
        rf"(?=([^\n]*))"
    )
    sections = captures.select("source_file", page.alias("page")).select(
        "source_file",
        F.posexplode(
            F.arrays_zip(
                F.concat(F.array(F.lit("")), F.regexp_extract_all("page", F.lit(heading), F.lit(0))).alias("heading"),
                F.split(F.col("page"), heading).alias("body"),
            )
        ).alias("section", "s"),
    )
    parts = [F.regexp_extract_all(F.col("s.body"), F.lit(block), F.lit(i)) for i in (1, 2, 3)]
    blocks = sections.select(
        "source_file", "section",
        clean_text(F.regexp_replace("s.heading", GLYPH, ""), ascii_only=ascii_only).alias("manager"),
        F.posexplode(F.arrays_zip(parts[0].alias("slot"), parts[1].alias("body"), parts[2].alias("after"))).alias("at", "b"),
    )
    # The name is the first following line that is not just a label.
    lines = F.filter(F.split(F.concat("b.body", "b.after"), "\n"), lambda x: x != "")
    named = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), strip_labels(x, ascii_only=True).alias("name"))),
        lambda p: p["name"] != "",
    )
    df = blocks.withColumns({"lines": lines, "first": F.try_element_at(named, F.lit(1))}).where(
        F.col("first").isNotNull()
    )
    seen = F.slice("lines", F.lit(1), F.col("first.i") + 1)
    statuses = F.filter(F.transform(seen, lambda x: inline_status(x, ascii_only=True)), lambda s: s != "")
    status = F.coalesce(F.try_element_at(statuses, F.lit(-1)), F.lit(""))
    df = df.withColumns({"yahoo_status": status, "player": clean_text(F.col("first.name"), ascii_only=ascii_only)})
    glued = F.col("yahoo_status").isin("O", "Q") & F.upper("player").endswith(F.col("yahoo_status"))
    team_line = F.regexp_extract(F.col("b.body"), rf"(?mi)^({TEAM_LINE})$", 1)
    upper_slot = F.upper("b.slot")
    rows = df.select(
        "source_file",
        (F.col("section").cast("long") * 1000000000 + F.col("at")).alias("source_order"),
        "manager",
        F.when(glued, F.trim(F.col("player").substr(F.lit(1), F.length("player") - 1))).otherwise(F.col("player")).alias("player"),
        F.regexp_extract(team_line, r"^([A-Za-z]+)", 1).alias("team"),
        F.coalesce(F.nullif(F.upper(F.regexp_extract(team_line, r"-\s*(.+)$", 1)), F.lit("")), upper_slot).alias("position"),
        upper_slot.alias("slot"),
        "yahoo_status",
    )
    return standardize_roster(rows, keep=("source_file", "source_order"), ascii_only=ascii_only)


def standardize_roster(df: DataFrame, *, keep: tuple[str, ...] = (), ascii_only: bool = False) -> DataFrame:
    """Any tabular roster in canonical form, duplicates dropped.

    BN becomes BENCH in ``position``; ``slot`` keeps the source spelling.
    """
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    df = resolve_aliases(df, ROSTER_ALIASES)
    if "player" not in df.columns:
        likely = [c for c in df.columns if "player" in c or "name" in c]
        if not likely:
            raise ValueError(f"Roster has no player column; found {df.columns}")
        df = df.withColumnRenamed(likely[0], "player")

    def text(name):
        return clean_text(F.col(name), ascii_only=ascii_only) if name in df.columns else F.lit("")

    df = df.select(*keep, *[text(c).alias(c) for c in ROSTER_COLUMNS if c != "player_normalized"])
    position = F.upper("position")
    df = df.withColumns(
        {
            "position": F.when(position.isin("D/ST", "DST"), "DEF").when(position == "BN", "BENCH").otherwise(position),
            "slot": F.upper("slot"),
            "player_normalized": name_key(F.col("player"), ascii_only=True),
        }
    )
    if not keep:
        return df.select(*ROSTER_COLUMNS).distinct()
    # Same roster row twice: keep the first place it stands at.
    order = [c for c in keep if c != "source_file"]
    keys = [*ROSTER_COLUMNS, *[c for c in keep if c == "source_file"]]
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in order]).select(*keep, *ROSTER_COLUMNS)


# ---------------------------------------------------------- tabular rosters


def read_tabular_roster(spark: SparkSession, path: str, fmt: str = "auto", *, ascii_only: bool = False) -> DataFrame:
    """TSV, CSV or columns two or more spaces apart, each with a header line.

    ``auto`` looks at the first line, as one file is one table.
    """
    if fmt == "auto":
        first = spark.read.text(path).where(F.trim("value") != "").take(1)
        if not first:
            raise ValueError(f"{path} is empty.")
        fmt = "tsv" if "\t" in first[0][0] else "csv" if "," in first[0][0] else "spaces"
    if fmt in ("tsv", "csv"):
        table = spark.read.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, quote='"', escape='"')
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
        head = lines.first()[0]
        names = re.split(r"\s{2,}", head.strip())
        if len(names) < 2:
            raise ValueError(f"{path} has no columns two or more spaces apart.")
        cells = F.split(F.trim("value"), r"\s{2,}")
        table = lines.where(F.col("value") != head).select(
            *[F.try_element_at(cells, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
        )
    return standardize_roster(table, ascii_only=ascii_only)


# --------------------------------------------------------------- HTML tables


def _tag(name: str) -> str:
    return rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"


def _cell_text(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return clean_text(text, ascii_only=True)  # of pages folded as a whole


def html_table_cells(pages: DataFrame, *, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """Every cell of every table of a corpus of pages: (page, table, row, column, text)."""
    pages = pages.select(id_column, fold_compatibility(F.col(html)).alias("html"))
    tables = pages.select(id_column, F.posexplode(F.regexp_extract_all("html", F.lit(_tag("table")), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(id_column, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(_tag("tr")), F.lit(1))).alias("row_no", "r"))
    cells = rows.select(
        id_column, "table_no", "row_no",
        F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1))).alias("col_no", "c"),
    )
    return cells.select(id_column, "table_no", "row_no", "col_no", _cell_text(F.col("c")).alias("cell"))


def html_rosters(pages: DataFrame, *, id_column: str = "page_id", html: str = "html", ascii_only: bool = False) -> DataFrame:
    """Roster rows of a corpus of pages.

    Of each page, the first table whose header names a player, name or position
    column is taken, else the first one. Headers may differ from page to page:
    they are matched to the logical columns by name, per row.
    """
    def cell_list(source: Column) -> Column:
        found = F.regexp_extract_all(source, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1))
        return F.transform(found, _cell_text)

    def first_row(t: Column) -> Column:
        return F.lower(F.array_join(cell_list(F.regexp_extract(t, _tag("tr"), 1)), " "))

    pages = pages.withColumn(html, fold_compatibility(F.col(html)))
    found = F.regexp_extract_all(html, F.lit(_tag("table")), F.lit(1))
    telling = F.filter(found, lambda t: first_row(t).rlike("player|name|position"))
    chosen = F.coalesce(F.try_element_at(telling, F.lit(1)), F.try_element_at(found, F.lit(1)))
    rows = F.transform(F.regexp_extract_all(chosen, F.lit(_tag("tr")), F.lit(1)), cell_list)
    header = F.transform(
        F.try_element_at("rows", F.lit(1)), lambda h: F.regexp_replace(F.lower(h), " ", "_")
    )
    body = (
        pages.select(id_column, rows.alias("rows"))
        .withColumn("header", header)
        .where(F.size("header") > 0)
        .select(id_column, "header", F.posexplode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("row_no", "r"))
    )

    def pick(aliases: list[str]) -> Column:
        at = F.lit(0)
        for a in reversed(aliases):
            place = F.array_position("header", a)
            at = F.when(place > 0, place).otherwise(at)
        return F.when(at > 0, F.try_element_at("r", at.cast("int")))

    logical = {**ROSTER_ALIASES, "yahoo_status": ["yahoo_status"]}
    table = body.select(id_column, "row_no", *[pick(a).alias(c) for c, a in logical.items()]).where(
        F.col("player").isNotNull()
    )
    return standardize_roster(
        table.withColumnRenamed(id_column, "source_file").withColumnRenamed("row_no", "source_order"),
        keep=("source_file", "source_order"), ascii_only=ascii_only,
    ).withColumnRenamed("source_file", id_column)


# ------------------------------------------------------------ matchup sheets

_POINTS = r"(?:[–—-]|-?\d+(?:\.\d+)?)"
_PLAYER = (
    r"(?:\(Empty\)\n|[^\n]+\n[A-Za-z]{2,4}\s*-\s*(?:QB|RB|WR|TE|K|DEF)\n"
    r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b|Bye\b)[^\n]*\n)"
)


def _pair(slots: str) -> str:
    """Left player, projection, points, slot, points, projection, right player."""
    return rf"{_PLAYER}(?:{_POINTS}\n){{2}}(?:{slots})\n(?:{_POINTS}\n){{2}}{_PLAYER}"


_STARTERS, _BENCH = _pair("QB|RB|WR|TE|W/R/T|K|DEF"), _pair("BN|IR")


def parse_matchups(
    captures: DataFrame, *, week: int | Column, league_id: str | Column, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two-sided pregame sheets to (rows, rejected files with the reason).

    A sheet is accepted only as a whole: right league and week, both tables
    expanded, two different managers, exactly the nine starter slots, one to
    seven bench pairs, totals rows in place, every player block used, nobody
    twice. Nothing is guessed; a sheet that has started or changed its layout
    is rejected. ``strict`` raises on the first rejected file.
    """
    week = F.lit(week) if not isinstance(week, Column) else week
    league = (F.lit(league_id) if not isinstance(league_id, Column) else league_id).cast("string")
    stamp = [c for c in captures.columns if c not in ("source_file", "value")]
    page = F.concat(F.array_join(_lines(F.col("value")), "\n"), F.lit("\n"))
    df = _computed(captures, {"_week": week.cast("int"), "_league": league, "page": page})
    df = _computed(
        df,
        {
            "leagues": F.regexp_extract_all("page", F.lit(r"\(ID#\s*([^)\n]*)\)"), F.lit(1)),
            "shown": F.regexp_extract("page", r"(?m)^Week (\d+):", 1),
            "parts": F.split(F.col("page"), rf"(?m)^{SHEET_HEADER}"),
            "blocks": F.size(
                F.regexp_extract_all("page", F.lit(r"(?m)^([A-Za-z]{2,4})\s*-\s*(?:QB|RB|WR|TE|K|DEF)$"), F.lit(1))
            ),
        },
    )
    df = _computed(
        df,
        {
            "managers": F.regexp_extract_all(
                F.element_at("parts", 1), F.lit(r"(?m)^([^\n]*)\n[^\n]*\n\d+-\d+-\d+\s*\|[^\n]*$"), F.lit(1)
            ),
            "top": F.regexp_extract(
                F.try_element_at("parts", F.lit(2)),
                rf"\A((?:{_STARTERS})*+)(?:{_POINTS}\n){{2}}TOTAL\n(?:{_POINTS}\n){{2}}", 1,
            ),
            "low": F.regexp_extract(
                F.try_element_at("parts", F.lit(3)), rf"\A((?:{_BENCH})*+){_POINTS}\nTOTAL\n{_POINTS}\n", 1
            ),
        },
    )
    slot_at = rf"\n({SLOTS})\n(?:{_POINTS}\n){{2}}"
    df = _computed(
        df,
        {
            "starters": F.regexp_extract_all("top", F.lit(_STARTERS), F.lit(0)),
            "bench": F.regexp_extract_all("low", F.lit(_BENCH), F.lit(0)),
        },
    )
    tables = F.concat(
        F.transform("starters", lambda p: F.struct(F.lit("starters").alias("table"), p.alias("pair"))),
        F.transform("bench", lambda p: F.struct(F.lit("bench").alias("table"), p.alias("pair"))),
    )

    def sides(t: Column) -> Column:
        """Both players of a pair: an empty place is one line, a player three; five cells between them."""
        lines = F.split(t["pair"], "\n")
        cells = F.when(lines[0] == "(Empty)", 1).otherwise(3)

        def line(at) -> Column:
            return F.get(lines, at)

        def side(start, cell, number: int) -> Column:
            return F.struct(
                t["table"].alias("table"), line(start).alias("name"), line(start + 1).alias("place"),
                line(start + 2).alias("game"), line(cell).alias("cell"), line(cells + 2).alias("slot"),
                F.lit(number).alias("side"),
            )

        return F.array(side(F.lit(0), cells, 1), side(cells + 5, cells + 4, 2))

    entries = F.filter(F.flatten(F.transform(tables, sides)), lambda e: e["name"] != "(Empty)")
    df = _computed(df, {"entries": entries})
    # All names of a sheet are folded as one value and parted again.
    joined = F.array_join(F.transform("entries", lambda e: strip_labels_and_status(e["name"])), "\n")
    df = _computed(df, {"names": F.split(fold_ascii(joined), "\n")})
    identity = F.transform(
        "entries",
        lambda e, i: F.concat_ws(
            "|", e["side"].cast("string"), F.regexp_extract(e["place"], r"([A-Z]+)$", 1), compact_key(F.get("names", i), folded=True)
        ),
    )
    slots = F.array_sort(F.transform("starters", lambda p: F.regexp_extract(p, slot_at, 1)))
    reason = (
        F.when(~F.array_contains("leagues", F.col("_league")), "league id missing or different")
        .when(F.coalesce(F.col("shown").try_cast("int") != F.col("_week"), F.lit(True)), "displayed week differs")
        .when((F.size("parts") != 3) | ~F.col("page").contains("\nHide Bench Players\n"), "starter and expanded bench tables expected")
        .when((F.size("managers") != 2) | (F.element_at("managers", 1) == F.try_element_at("managers", F.lit(2))), "two distinct managers expected")
        .when(F.col("top") == "", "starter table has an unexpected layout")
        .when(F.col("low") == "", "bench table has an unexpected layout")
        .when((F.size("starters") != 9) | ~F.size("bench").between(1, 7), "unexpected table size")
        .when(slots != F.array(*[F.lit(s) for s in STARTER_SLOTS]), "starter slots do not match the league")
        .when(F.size("entries") != F.col("blocks"), "some player blocks were not parsed")
        .when(F.size(F.array_distinct(identity)) != F.size("entries"), "duplicate player entries")
    )
    df = _computed(df, {"error": reason})
    if strict:
        stop = F.raise_error(F.concat_ws(": ", "source_file", "error")).cast("string")
        df = df.withColumn("error", F.when(F.col("error").isNotNull(), stop))
    rows = df.where(F.col("error").isNull()).select(
        "source_file", *stamp, "_week", "_league", "managers", F.explode("entries").alias("e")
    )
    parsed = rows.select(
        strip_labels_and_status(F.col("e.name")).alias("player_name"),
        team_code(F.regexp_extract("e.place", r"^([A-Za-z]{2,4})\s*-", 1), ascii_only=True).alias("team"),
        F.regexp_extract("e.place", r"([A-Z]+)$", 1).alias("position"),
        F.col("e.game").alias("game_label"),
        F.element_at("managers", F.col("e.side")).alias("manager"),
        F.col("e.slot").alias("slot"),
        points_cell(F.col("e.cell")).alias("yahoo_projection"),
        F.col("_week").alias("week"),
        F.col("_league").alias("league_id"),
        F.col("e.table").alias("table"),
        "source_file", *stamp,
    )
    rejected = df.where(F.col("error").isNotNull()).select("source_file", "error")
    return parsed, rejected


# ------------------------------------------------------------- import batches

_SIDECAR = "sha256 string, season int, week int, captured_at_utc string"


def read_capture_batch(spark: SparkSession, path: str, *, season: int, week: int) -> DataFrame:
    """Text captures of a folder with hash, provenance and capture time.

    ``name.txt.json`` next to ``name.txt`` is its provenance. It must agree in
    hash, season and week and give a zoned time that is not in the future; the
    reason it does not is in ``provenance_error``. Without provenance the
    capture time is null: file times are never used.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    texts = files.where(~F.col("path").endswith(".json")).select(
        F.col("path").alias("source_file"),
        F.decode("content", "UTF-8").alias("value"),
        F.sha2("content", 256).alias("sha256"),
    )
    notes = files.where(F.col("path").endswith(".json")).select(
        F.regexp_replace("path", r"\.json$", "").alias("source_file"),
        F.from_json(F.decode("content", "UTF-8"), _SIDECAR).alias("note"),
    )
    df = texts.join(notes, "source_file", "left")
    stamp = F.col("note.captured_at_utc")
    moment = F.try_to_timestamp(stamp)
    error = F.when(
        F.col("note").isNotNull(),
        F.when(
            ~(
                F.coalesce(F.col("note.sha256") == F.col("sha256"), F.lit(False))
                & F.coalesce(F.col("note.season") == season, F.lit(False))
                & F.coalesce(F.col("note.week") == week, F.lit(False))
            ),
            "provenance does not match",
        ).when(
            moment.isNull() | ~stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$") | (moment > F.current_timestamp()),
            "capture time must have a zone and cannot be in the future",
        ),
    )
    return df.select(
        "source_file", "value", "sha256",
        F.when(error.isNull(), moment).alias("captured_at_utc"), error.alias("provenance_error"),
    )


def import_captures(
    spark: SparkSession, path: str, roster: DataFrame, root: str, *, season: int, week: int, league_id: str,
    batch_id: str, strict: bool = True,
) -> DataFrame:
    """Parse, reconcile and append one import batch; returns its summary row.

    Every table is appended under ``batch_id``; earlier batches are not touched. The files are read once and parsed once:
    the texts and what is parsed from them are stored, and the seven tables and their checks are made from that.
    """
    files = stored(read_capture_batch(spark, path, season=season, week=week), "import-files")
    wrong = files.where(F.col("provenance_error").isNotNull()).select("source_file", F.col("provenance_error").alias("error"))
    if strict and (first := wrong.take(1)):
        raise ValueError(f"{first[0].source_file}: {first[0].error}")
    usable = files.where(F.col("provenance_error").isNull()).select("source_file", "captured_at_utc", "value")
    captured, rejected = parse_matchups(usable, week=week, league_id=league_id, strict=strict)
    captured = stored(captured, "import-captured")
    coverage, unexpected = (stored(df, "import-checked") for df in reconcile(captured, roster, strict=strict))
    summary = coverage_summary(coverage, captured, unexpected).withColumns(
        {
            "parser_version": F.lit(PARSER_VERSION), "season": F.lit(season), "week": F.lit(week),
            "imported_at_utc": F.current_timestamp(),
        }
    )
    tables = {
        "sources": files.select("source_file", "sha256", "captured_at_utc", "value"),
        "captured": captured, "coverage": coverage, "unexpected": unexpected,
        "rejected": rejected.unionByName(wrong), "roster_mapping": roster, "summary": summary,
    }
    for name, table in tables.items():
        table.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/summary").where(F.col("batch_id") == batch_id)

