"""CSV in and out: the first lines tell separator, header and quoting, all lines tell width and types; Spark reads the file with an explicit schema."""

from __future__ import annotations

import io
import re
import tarfile
import warnings
import zipfile
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.frame import Frame
from slate.sources.staged import fresh_path

SEPARATORS = ",\t |;:"
#: What spreadsheets and C libraries write for numbers that are none, and for infinite ones.
SPECIAL = {
    **dict.fromkeys(["#DIV/0!", "#NUM!", "#VALUE!", "#NULL!", "#NAME?", "#REF!", "1.#SNAN", "1.#QNAN", "1.#IND", "-1.#IND", "nan", "NAN", "qNaN", "sNaN"], "NaN"),
    "1.#INF": "Infinity",
    "-1.#INF": "-Infinity",
}
#: Files whose heads are broadcast.
FILES = 10_000
#: Always missing in a column of numbers.
NO_NUMBER = "#N/A"
_HEX = r"([+-]?)0[xX]([0-9a-fA-F]+)\.?([0-9a-fA-F]*)[pP]([+-]?\d+)"
_WORDS = "|".join(map(re.escape, [*SPECIAL, NO_NUMBER]))
_ZONE = r"(?:Z|[+-]\d\d:?\d\d)"


def kinds_of(dec: str) -> tuple[tuple[str, str], ...]:
    """Types from narrow to wide, and the texts that each takes."""
    d = re.escape(dec)
    return (
        *[("boolean", words) for words in ("TRUE|FALSE", "True|False", "true|false")],
        ("int", r"[+-]?\d{1,10}"),
        ("bigint", r"[+-]?\d{1,19}"),
        ("double", rf"[+-]?(\d+{d}?\d*|{d}\d+)([eE][+-]?\d+)?|[+-]?(Inf(inity)?|inf|INF)|NaN|{_HEX}|{_WORDS}"),
        ("date", r"\d{4}-\d\d-\d\d"),
        ("timestamp_ntz", rf"\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?{_ZONE}?"),
    )


#: Ways of quoting, in the order in which they are tried: inner quotes doubled, inner quotes after a backslash, inner quotes as
#: they are (one before a separator ends the field), no quoting.
QUOTING = ("double", "escape", "verbatim", "none")


def _field(sep: str, quote: str, rule: str) -> str:
    """Pattern of a field; it is read off after each separator."""
    q, rest = re.escape(quote), rf"[^{re.escape(sep)}]*+"
    inner = {"double": rf" *{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q} *+(?={re.escape(sep)}|\z)", "escape": rf" *{q}(?:[^{q}\\]|\\.)*+{q} *+(?={re.escape(sep)}|\z)", "verbatim": rf" *{q}.*?{q} *(?={re.escape(sep)}|\z)"}
    return rest if rule == "none" or not quote else rf"(?:{inner[rule]}|{rest})"


def _unquoted(text: str, quote: str, rule: str) -> str:
    text = text.strip()
    if rule == "none" or not quote or len(text) < 2 or not (text[0] == text[-1] == quote):
        return text
    return {"double": text[1:-1].replace(quote * 2, quote), "escape": re.sub(r"\\(.)", r"\1", text[1:-1]), "verbatim": text[1:-1]}[rule]


def _fields(line: str, sep: str, quote: str, rule: str) -> list[str]:
    line = re.sub(" +", " ", line.strip()) if sep == " " else line
    found = re.findall(f"{re.escape(sep)}({_field(sep, quote, rule)})".replace(r"\z", r"\Z"), sep + line, re.S)
    return [_unquoted(f[0] if isinstance(f, tuple) else f, quote, rule) for f in found]


def split_line(line: Column, sep: str, quote: str, rule: str) -> Column:
    """The fields of a record as an array, quotes taken off."""
    line = F.regexp_replace(F.btrim(line), " +", " ") if sep == " " else line
    parts = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"(?s){re.escape(sep)}({_field(sep, quote, rule)})"), F.lit(1))
    blanks = F.lit(" \t\n\r\f\v")
    parts = F.transform(parts, lambda p: F.btrim(p, blanks))
    if rule == "none" or not quote:
        return parts

    def plain(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        inner = {"double": lambda: F.replace(inner, F.lit(quote * 2), F.lit(quote)), "escape": lambda: F.regexp_replace(inner, r"(?s)\\(.)", "$1"), "verbatim": lambda: inner}[rule]()
        return F.when((F.length(p) > 1) & p.startswith(quote) & p.endswith(quote), inner).otherwise(p)

    return F.transform(parts, plain)


def kind(values: Sequence[str], na: Sequence[str] = ("NA", ""), keep_zeros: bool = False, dec: str = ".") -> str:
    """The narrowest type that fits all values."""
    known = [v.strip() for v in values if v.strip() not in na]
    if not known:
        return "string"
    if keep_zeros and any(re.fullmatch(r"[+-]?0\d+", v) for v in known):
        return "string"
    return next((name for name, pattern in kinds_of(dec) if all(re.fullmatch(pattern, v) for v in known)), "string")


@dataclass
class Sniffed:
    sep: str
    header: bool
    names: list[str]
    skip: int = 0
    quote: str = '"'
    rule: str = "double"


def sniff(spark: SparkSession, path: str, lines: int = 100, na: Sequence[str] = ("NA", ""), keep_zeros: bool = False, sep: str | None = None, header: bool | None = None, skip: int | str = 0, comment: str | None = None, quote: str = '"', quoting: str | None = None) -> Sniffed:
    """Separator, header, names and way of quoting from the first lines only; ``read_csv`` looks at the others."""
    sample = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).limit(100_000 if isinstance(skip, str) else lines + skip).collect()
    # Files have heads of their own: the one that the sample has most of speaks for all.
    file = Counter(r.file for r in sample).most_common(1)[0][0] if sample else ""
    rows = [r.value for r in sample if r.file == file]
    rows = [r.lstrip("\ufeff") if k == 0 else r for k, r in enumerate(rows)]
    if isinstance(skip, str):
        skip = next((k for k, r in enumerate(rows) if skip in r), None)
        if skip is None:
            raise ValueError("no line holds the text to skip to")
    kept = [k for k, r in enumerate(rows[skip:][:lines], skip) if r.strip() and not (comment and r.startswith(comment))]
    skip, rows = (kept[0] if kept else skip), [rows[k] for k in kept]
    if not rows:
        return Sniffed(sep or ",", False, [], skip, quote, quoting or "double")

    def best(rule: str) -> tuple[float, str, list[list[str]]]:
        """How many lines have the commonest number of fields, over 1, for the best separator."""
        found = []
        for s in [sep] if sep else SEPARATORS:
            split = [_fields(r, s, quote, rule) for r in rows]
            k, n = Counter(map(len, split)).most_common(1)[0]
            spoilt = sum(any(f.count(quote) % 2 and rule != "none" for f in r) for r in split) if quote else 0
            found.append((-1 if k == 1 and not sep else n - spoilt, k, s, split))
        n, _, s, split = max(found, key=lambda f: (f[0], min(f[1], 2), -SEPARATORS.index(f[2]) if f[2] in SEPARATORS else 0))
        return n, s, split

    tried = {rule: best(rule) for rule in ([quoting] if quoting else QUOTING)}
    rule = max(tried, key=lambda r: (tried[r][0], -QUOTING.index(r)))
    _, sep, split = tried[rule]
    common = Counter(map(len, split[1:] or split)).most_common(1)[0][0]
    width = max(map(len, split))
    body = [[r[k] if k < len(r) else "" for k in range(width)] for r in split]
    below = [kind([r[k] for r in body[1:]], na, keep_zeros) for k in range(width)]
    if header is None:
        header = len(body) > 1 and all(v and kind([v]) == "string" for v in body[0][: min(common, len(split[0]))]) and (any(t != "string" for t in below) or len(set(split[0])) == len(split[0]) and not set(split[0]) & {v for r in body[1:] for v in r})
    return Sniffed(sep, header, _widened(split[0] if header else [], width), skip, quote, rule)


def _widened(names: Sequence[str], width: int) -> list[str]:
    """``names`` and, up to ``width``, V and the column's number, or the next number that is free."""
    out = list(names)
    while len(out) < width:
        out.append(next(n for n in (f"V{k}" for k in range(len(out) + 1, 2 * width + 2)) if n not in out))
    return [n or f"V{k}" for k, n in enumerate(out, 1)]


def _records(spark: SparkSession, path: str, s: Sniffed, comment: str | None, multiline: bool | None) -> DataFrame:
    """(value) of every record below each file's head; fields may hold line ends if ``multiline``, or (None) if quotes say so."""
    head = s.skip + s.header
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if head:
        numbered = text.withColumn("at", F.monotonically_increasing_id())
        # A file's head is in its first block, and the lines of a block are numbered one after the other.
        firsts = numbered.where("block = 0").groupBy("file").agg(F.min("at").alias("first"))
        firsts = F.broadcast(firsts) if len(text.inputFiles()) <= FILES else firsts  # keeps the rows in the files' order
        rows = numbered.join(firsts, "file").where((F.col("block") > 0) | (F.col("at") - F.col("first") >= head)).select("value")
    else:
        rows = text.select("value")
    quoted = s.rule in ("double", "escape") and bool(s.quote)
    if multiline is None and quoted:
        plain = F.regexp_replace("value", r"\\.", "") if s.rule == "escape" else F.col("value")
        multiline = not rows.where((F.length(plain) - F.length(F.replace(plain, F.lit(s.quote)))) % 2 == 1).isEmpty()
    if multiline and quoted:  # a file is one value here, as a quote may stand anywhere
        q = re.escape(s.quote)
        inner = rf"{q}[^{q}]*+{q}" if s.rule == "double" else rf"{q}(?:[^{q}\\]|\\.)*+{q}"
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), rf"(?s)^(?:[^\n]*\n){{{s.skip}}}" if s.skip else "^\ufeff", "").alias("value"))
        records = F.regexp_extract_all("value", F.lit(rf"(?s)(?:{inner}|[^\n{q}])++"), F.lit(0))
        rows = whole.select(F.posexplode(records).alias("at", "value")).where(F.col("at") >= int(s.header)).select("value")
    rows = rows.select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value")).where(F.btrim("value") != "")
    return rows.where(~F.col("value").startswith(comment)) if comment else rows


def _kinds(raw: DataFrame, names: Sequence[str], given: dict[str, str], na: Sequence[str], keep_zeros: bool, dec: str, logical01: bool, logical_yn: bool, integer64: str) -> dict[str, str]:
    """The narrowest type of each column that loses no value of any row, or its given one if that loses none, by one aggregate."""
    tests = [("logical01", "[01]")] * logical01 + [("logicalYN", "[YN]")] * logical_yn + list(kinds_of(dec))
    sums = []
    for i, n in enumerate(names):
        c = F.btrim(F.col(f"`{n}`"), F.lit(" \t\n\r\f\v"))
        known = c.isNotNull() & ~c.isin(list(na))
        sums += [F.count_if(known).alias(f"n{i}"), F.count_if(known & c.rlike(r"^[+-]?0\d+\z")).alias(f"z{i}")]
        if n in given:
            fits = _cast(c, given[n], na, dec, integer64).isNotNull() | (c == NO_NUMBER)
            sums.append(F.count_if(known & ~fits).alias(f"g{i}"))
        for k, (name, pattern) in enumerate(tests):
            fits = c.rlike(rf"^(?:{pattern})\z") & (_cast(c, name, na, dec, integer64).isNotNull() | (c == NO_NUMBER))
            sums.append(F.count_if(known & ~fits).alias(f"k{i}_{k}"))
    if not sums:
        return {}
    row = raw.agg(*sums).first()
    out = {}
    for i, n in enumerate(names):
        settled = not row[f"n{i}"] or (keep_zeros and row[f"z{i}"])
        out[n] = "string" if settled else next((name for k, (name, _) in enumerate(tests) if not row[f"k{i}_{k}"]), "string")
        if n in given:
            if not row[f"g{i}"]:
                out[n] = given[n]
            else:
                warnings.warn(f"{row[f'g{i}']} values of {n} are no {given[n]}: it is read as {out[n]}", stacklevel=3)
    return out


def read_csv(spark: SparkSession, path: str, select: Sequence[str | int] | None = None, drop: Sequence[str | int] = (), types: dict[str, str] | None = None, na: Sequence[str] = ("NA", ""), dec: str | None = None, logical01: bool = False, logical_yn: bool = False, integer64: str = "bigint", nrows: int | None = None, csvy: bool = False, fill: bool | int = True, multiline: bool | None = None, col_names: Sequence[str] | None = None, **kw) -> DataFrame:
    """Read with sniffed names and the types and width that hold all rows. Values are read as text and cast, so all ``na`` tokens and special numbers hold.

    ``path`` is a file, a folder or a pattern; every file has the same head. The file is read once for its width and once for
    types. A type of ``types`` that would lose a value is left aside, with a warning. ``dec`` is found, if not given, from which
    of ``.`` and ``,`` makes more columns numbers. Short rows are filled with missing values, ``fill=False`` makes them an error,
    a number asks for as many columns at least. ``csvy`` takes names, types, separator, quote, decimal mark, missing tokens and header from a
    YAML head between ``---`` lines; what is given here wins. Quoted fields may hold line ends. ``select`` and ``drop`` take
    names or numbers from 1. A zip or tar archive has to hold one file.
    """
    path = _unpacked(spark, path)
    head = _yaml_head(spark, path) if csvy else None
    if head:
        kw["skip"] = head["lines"] + (kw.get("skip") or 0)
        for name in ("sep", "quote", "header"):
            if name in head:
                kw.setdefault(name, head[name])
        dec, na = dec or head.get("dec"), head["na"] if "na" in head and tuple(na) == ("NA", "") else na
        types = {**head["types"], **(types or {})}
    s = sniff(spark, path, na=na, **kw)
    if head and not s.header and col_names is None:
        col_names = list(head["types"]) or None
    if len(set(s.names)) < len(s.names):
        raise ValueError("column names repeat")
    records = _records(spark, path, s, kw.get("comment"), multiline)
    fields = records.select(split_line(F.col("value"), s.sep, s.quote, s.rule).alias("f"))
    most, least = fields.agg(F.max(F.size("f")), F.min(F.size("f"))).first()
    width = max(most or 0, len(s.names), fill if fill is not True else 0)
    if fill is False and least is not None and least != width:
        raise ValueError(f"lines have from {least} to {most} fields; allow it by fill=True")
    every = _widened(s.names, width)
    if col_names is not None:
        every = [*col_names, *every[len(col_names) :]]
    raw = fields.select(*[F.get("f", F.lit(k)).alias(n) for k, n in enumerate(every)])
    by_name = lambda c: every[c - 1] if isinstance(c, int) else c
    names = [n for n in (map(by_name, select) if select is not None else every) if n not in {by_name(d) for d in drop}]
    if unknown := [n for n in names if n not in every]:
        raise ValueError(f"no column {unknown[0]!r}")
    given = {n: t for n, t in (types or {}).items() if n in names}
    ask = lambda d: _kinds(raw, names, given, na, kw.get("keep_zeros", False), d, logical01, logical_yn, integer64)
    found = ask(dec or ".")
    if dec is None and s.sep != "," and "string" in found.values():
        other = ask(",")
        if sum(t == "string" for t in other.values()) < sum(t == "string" for t in found.values()):
            dec, found = ",", other
    out = raw.select(*[_cast(F.col(f"`{n}`"), found[n], na, dec or ".", integer64).alias(n) for n in names])
    return out.limit(nrows) if nrows is not None else out


def read_frame(spark: SparkSession, path: str, key: Sequence[str] = (), index: Sequence[str] = (), **kw) -> Frame:
    """``read_csv``, sorted and keyed by some columns, with a note of an index."""
    frame = Frame(read_csv(spark, path, **kw))
    frame = frame.set_key(*key) if key else frame
    return frame.set_index(*index) if index else frame


def _cast(c: Column, to: str, na: Sequence[str], dec: str, integer64: str) -> Column:
    c = F.when(~c.isin(list(na)), c)
    if to == "double":
        sign, whole, part, power = (F.regexp_extract(c, f"^{_HEX}$", k) for k in (1, 2, 3, 4))
        hex_ = F.conv(F.concat(whole, part), 16, 10).cast("double") * F.pow(F.lit(16.0), -F.length(part)) * F.pow(F.lit(2.0), power.cast("double")) * F.when(sign == "-", -1.0).otherwise(1.0)
        text = F.coalesce(*[F.when(c.isin([w for w, v in SPECIAL.items() if v == value]), value) for value in sorted(set(SPECIAL.values()))], c)
        text = F.regexp_replace(text, r"^([+-]?)(?:Inf|inf|INF)(?:inity)?$", "$1Infinity")
        text = F.regexp_replace(text, r"^\+", "")
        number = (F.replace(text, F.lit(dec), F.lit(".")) if dec != "." else text).try_cast("double")
        return F.when(c.rlike(f"^{_HEX}$"), hex_).otherwise(number)
    if to == "bigint":
        to = integer64
    if to == "timestamp_ntz":
        zoned = c.rlike(_ZONE + r"\z")
        at = F.try_to_timestamp(c)
        return F.when(zoned, F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")).otherwise(at.cast("timestamp_ntz"))
    if to == "logical01":
        return F.when(c.isin("0", "1"), c == "1")
    if to == "logicalYN":
        return F.when(c.isin("Y", "N"), c == "Y")
    return c if to == "string" else F.when(c != NO_NUMBER, c).try_cast(to) if to in ("int", "bigint") else c.try_cast(to)


def _yaml_head(spark: SparkSession, path: str) -> dict | None:
    """What a YAML head of the customary shape says: a list of fields below ``schema``, and plain keys."""
    rows = [r.value.lstrip("\ufeff") for r in spark.read.text(path).limit(2000).collect()]
    if not rows or rows[0].strip("# ") != "---":
        return None
    end = next((k for k in range(1, len(rows)) if rows[k].strip("# ") == "---"), None)
    if end is None:
        raise ValueError("the YAML head has no end")
    rows = [re.sub("^#", "", r) for r in rows[: end + 1]]
    types, name, out = {}, None, {"lines": len(rows)}
    kinds = {"integer": "int", "int": "int", "numeric": "double", "number": "double", "double": "double", "boolean": "boolean", "logical": "boolean", "date": "date", "integer64": "bigint", "int64": "bigint"}
    keys = {"delimiter": "sep", "quoteChar": "quote", "quote_char": "quote", "decimal": "dec", "na.strings": "na"}
    listed = None
    for line in rows[1:-1]:
        item = re.fullmatch(r"\s*-\s*(['\"]?)(.*?)\1\s*", line)
        if listed is not None and item and ":" not in item[2]:
            listed.append(item[2])
            continue
        key, _, value = line.strip().lstrip("- ").partition(":")
        value, listed = value.strip(), None
        plain = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
        plain = plain.replace("\\t", "\t") if value.startswith('"') else plain
        key = keys.get(key, key)
        if key == "name" and line.lstrip().startswith("-"):
            name = plain
        elif key == "type" and name:
            types[name] = kinds.get(plain, "string")
        elif key == "header":
            out["header"] = plain.lower() in ("true", "yes")
        elif key == "na":
            listed = out["na"] = [x.strip(" '\"") for x in plain.strip("[]").split(",")] if value else []
        elif key in ("sep", "quote", "dec") and plain:
            out[key] = plain
    return out | {"types": types}


def _unpacked(spark: SparkSession, path: str) -> str:
    """The path of an archive's one member, written to the shared folder; other paths as they are (gz and bz2 are read as such)."""
    if not re.search(r"\.(zip|tar|tgz|tar\.gz|tar\.bz2)$", path):
        return path

    def lines(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        members = [z.read(n) for n in z.namelist() if not n.endswith("/")]
                else:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        members = [t.extractfile(m).read() for m in t.getmembers() if m.isfile()]
                if len(members) != 1:
                    raise ValueError(f"the archive holds {len(members)} files, not one")
                rows = members[0].decode("utf-8").splitlines()
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[k : k + 10_000])], ["value"])

    to = fresh_path(spark)
    spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string").write.text(to)
    return to


def write_csv(df: DataFrame, path: str, sep: str = ",", sep2: str = "|", na: str = "", header: bool = True, logical01: bool = False, date_times: str = "ISO", compress: str | None = None, quote: bool | str = "auto", qmethod: str = "double", dec: str = ".", mode: str = "error", yaml: bool = False, bom: bool = False) -> None:
    """Write in parallel, a file for each partition; list columns are joined by ``sep2``.

    ``quote`` is ``auto`` (fields that need it), True (all) or False (none); inner quotes are doubled or, with
    ``qmethod="escape"``, follow a backslash. ``mode="append"`` adds files without looking at those that are there. ``yaml``
    puts names and types in a YAML head, ``bom`` a byte-order mark before it; both are for one file, which one task writes.
    """
    if dec == sep:
        raise ValueError("fields and decimals need different marks")
    out = []
    for name, kind_ in df.dtypes:
        c = F.col(f"`{name}`")
        if kind_.startswith("array"):
            c = F.array_join(c.cast("array<string>"), sep2)
        elif kind_ == "boolean":
            c = c.cast("int") if logical01 else F.upper(c.cast("string"))
        elif kind_ in ("timestamp", "timestamp_ntz"):
            c = {"ISO": F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "squash": F.date_format(c, "yyyyMMddHHmmssSSS"), "epoch": F.unix_micros(c.cast("timestamp")) / 1e6}[date_times]
        elif kind_ == "date":
            c = {"ISO": c.cast("string"), "squash": F.date_format(c, "yyyyMMdd"), "epoch": F.unix_date(c)}[date_times]
        elif kind_ in ("double", "float") or kind_.startswith("decimal"):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(dec)) if dec != "." else c
        out.append(c.alias(name))
    options = {"sep": sep, "nullValue": na, "emptyValue": '""' if quote else "", "quoteAll": quote is True, "escape": '"' if qmethod == "double" else "\\", "quote": '"' if quote else ""}
    writer = df.select(*out).write.mode(mode).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).option("header", header)
    if not (yaml or bom):
        (writer.option("compression", compress) if compress else writer).csv(path)
        return
    back = {"int": "integer", "bigint": "integer64", "double": "numeric", "float": "numeric", "boolean": "logical", "date": "date"}
    head = ["---", "schema:", "  fields:", *[x for n, t in df.dtypes for x in (f"  - name: {n}", f"    type: {back.get(t, 'character')}")], f"header: {str(header).lower()}", f'sep: "{sep}"', f'dec: "{dec}"', f"na.strings: '{na}'", "---"] if yaml else []
    titles = [sep.join(df.columns)] if header else []
    above = [(k, line) for k, line in enumerate(head + titles)]
    above[:1] = [(0, "\ufeff" * bom + above[0][1])] if above else []
    rows = df.select(*out).select(F.to_csv(F.struct(*df.columns), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).alias("value"))
    first = df.sparkSession.createDataFrame(above, "at int, value string").coalesce(1).sortWithinPartitions("at").select("value")
    lines = first.union(rows).coalesce(1).write.mode(mode)
    (lines.option("compression", compress) if compress else lines).text(path)
