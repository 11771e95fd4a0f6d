"""Texts cut off by field limits or in transfer.

Lengths are recomputed as characters, UTF-8 bytes and UTF-16 units, after entity escaping, JSON
escaping and newline conversion. Grouped by source and length, a hidden storage limit shows as a
length at which far more distinct texts stand than at its neighbours. The ending of every text is
then inspected: what a diff announces, whether a sentence, trailer, path or word is finished.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut

MEASURES = ["chars", "bytes", "utf16", "entity", "json", "crlf", "lf"]
LEAST_AT_LIMIT = 5
LEAST_OPEN = 0.5
LIMIT_RATIO = 8.0
NEIGHBOURS = 25

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_STAT = re.compile(r"^ (\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?[ \t]*$", re.M)
_STAT_LINE = re.compile(r" \S.* \|\s*(?:Bin\b.*|\d+ ?[+-]*)?$| \d+ files? chang\w*.*$")
_FOOT = re.compile(r"(?:\n-- \npatch\w+ [\d.]+|\n={20,})\s*\Z")
_DONE = re.compile(r"[.!?。！？][\"'”’»)\]]*\s*\Z")
_TRAILER = re.compile(r"\s*[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: ")
_BULLET = re.compile(r"\s*[-*] ")
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,}|Author: |Date: |Merge: |# rev |# by |# on )")
_OPEN_DIFF = "diff --git "


def _hunks_open(section: list[str]) -> bool | None:
    """Whether the last hunk of a file section has fewer lines than it announces; None without hunks."""
    at = None
    for i in range(len(section) - 1, -1, -1):
        if section[i].startswith("@@"):
            at = i
            break
    if at is None:
        return None
    m = _HUNK.match(section[at])
    if not m:
        return True
    old, new = int(m.group(1) or 1), int(m.group(2) or 1)
    for line in section[at + 1 :]:
        if old <= 0 and new <= 0:
            return False
        c = line[:1]
        if c == "-":
            old -= 1
        elif c == "+":
            new -= 1
        elif c != "\\":
            old -= 1
            new -= 1
    return old > 0 or new > 0


def _file_open(section: str) -> bool:
    """Whether the last file of a diff breaks off."""
    lines = section.split("\n")
    hunks = _hunks_open(lines)
    if hunks is not None:
        return hunks
    if "\nBinary files " in section:
        return not re.search(r"\nBinary files .* differ\s*$", section)
    if "\nGIT binary patch" in section:
        body = [x for x in section[section.index("\nGIT binary patch") + 1 :].split("\n")[1:] if x]
        if len(body) < 2 or not re.match(r"(?:literal|delta) \d+$", body[0]):
            return True
        c = body[-1][0]
        size = ord(c) - 64 if "A" <= c <= "Z" else ord(c) - 70 if "a" <= c <= "z" else -1
        short = len(body[-1]) < 5 * ((size + 3) // 4)
        return size > 0 and short and (len(body) == 2 or len(body[-1]) < len(body[-2]))
    if m := re.search(r"\n(?:rename|copy) to (.*)", section):
        was = re.search(r"\n(?:rename|copy) from (.*)", section)
        suffix = lambda p: p.strip().rpartition("/")[2].rpartition(".")[2]
        return bool(was) and "." in was.group(1) and suffix(m.group(1)) != suffix(was.group(1))
    if re.search(r"\nnew mode \d{6}$", section, re.M) or re.search(r"^index 0{7,}\.\.e69de29|^index e69de29[0-9a-f]*\.\.0{7,}", section, re.M):
        return False
    return True


def diff_state(text: str) -> str | None:
    """``open``, ``whole`` or ``done`` for a text with a diff, else None.

    All lines that a ``whole`` diff announces are there, but its last line might be cut; a ``done``
    one ends its last line too.
    """
    i = 0 if text.startswith(_OPEN_DIFF) else text.find("\n" + _OPEN_DIFF) + 1
    if i == 0 and not text.startswith(_OPEN_DIFF):
        return None
    body = text[i:]
    foot = _FOOT.search(body)
    if foot:
        body = body[: foot.start()]
    stat = _STAT.search(text, 0, i)
    if stat and body.count("\n" + _OPEN_DIFF) + 1 < int(stat.group(1)):
        return "open"
    if body.rstrip().endswith("…") or _file_open(body[body.rfind("\n" + _OPEN_DIFF) + 1 :]):
        return "open"
    if stat:
        plus = body.count("\n+") - body.count("\n+++ b/") - body.count("\n+++ /dev/null")
        minus = body.count("\n-") - body.count("\n--- a/") - body.count("\n--- /dev/null")
        if plus < int(stat.group(2) or 0) or minus < int(stat.group(3) or 0):
            return "open"
    return "done" if foot or body.endswith("\n") else "whole"


def _trailer_done(line: str) -> bool | None:
    """Whether a trailer is complete; None if only its last word can tell."""
    name, _, value = line.strip().partition(": ")
    if name in ("Signed-off-by", "Co-authored-by", "Reported-by", "Tested-by") or "<" in value:
        return value.endswith(">")
    if name == "Change-Id":
        return bool(re.fullmatch(r"I[0-9a-f]{40}", value))
    if re.search(r"\d$", value):
        return True
    return None


def _columns(lines: list[str]) -> str | None:
    """State of a table by its last row; None if the lines are no table.

    Rows of a table have the same number of separators, or of gaps between columns.
    """
    for sep, least in ((r"\S\s*\|(?=\s*\S)", 3), (r"\t", 3), (r"\S {2,}(?=\S)", 4), (r";", 4), (r",", 4)):
        counts = [len(re.findall(sep, x)) for x in lines]
        if len(lines) >= least and counts[0] and len(set(counts[:-1])) == 1 and (sep in (r"\t", r"\S\s*\|(?=\s*\S)") or counts[0] > 1):
            closed = lines[0].rstrip()[-1:] == lines[-2].rstrip()[-1:] == "|"
            return "done" if counts[-1] == counts[0] and (not closed or lines[-1].rstrip().endswith("|")) else "open"
    return None


_CODE_LINE = re.compile(r".*[;{}:)\]]\s*\Z|\s*(?:return|def|class|if|for|while|import|from|else|elif|end|fn|func|let|var|const)\b|[^.!?]*\S\s=\s\S")
_OPENERS, _CLOSERS = "([{", ")]}"


def _program(lines: list[str]) -> str | None:
    """State of a block of code by its brackets; None if most lines are none."""
    if len(lines) < 3 or sum(bool(_CODE_LINE.match(x)) for x in lines) < 0.6 * len(lines) or not _CODE_LINE.match(lines[-1]):
        return None
    plain = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", "\n".join(lines))
    depth = sum(plain.count(c) for c in _OPENERS) - sum(plain.count(c) for c in _CLOSERS)
    return "done" if depth <= 0 and not re.search(r"[,(\[{=+*/&|-]\s*\Z", plain) else "open"


def _short_units(paras: list[str], lines: list[str]) -> bool:
    """Whether the last paragraph is made of short lines that are no sentences: verse like what stands before it, or a signature."""
    units = [x.strip() for x in lines]
    capital = all(x[:1].isupper() or x[:1].isdigit() for x in units)
    if not capital or max(map(len, units)) > 60:
        return False
    before = [x.strip() for p in paras[:-1] for x in p.strip().split("\n")]
    verse = len(units) > 1 and len(before) > 1 and max(map(len, before)) <= 60 and sum(not _DONE.search(x) for x in before) >= 0.5 * len(before)
    words = [w for x in units for w in x.split()]
    names = sum(w[:1].isupper() for w in words) >= 0.6 * len(words) and len(words) <= 5 * len(units)
    greeting = (len(units) > 1 and units[0].endswith(",")) or (len(words) > 1 and bool(before) and before[-1].endswith(","))
    return verse or (names and greeting and len(units) <= 4)


_INNER_END = re.compile(r"[a-z][.!?][\"')\]]*\s+(?=[A-Z\"'(])")
PROSE = 160  # signs from which a paragraph of sentences is no headline


def message_state(text: str) -> tuple[str, str]:
    """``done``, ``open``, ``title``, ``bullet`` or ``trailer`` for a text without a diff, and its last word.

    A text is held against its own ways: rows of a table against the rows before them, code
    against its brackets, short lines against those above. A lone paragraph is a headline unless
    it is long and made of sentences.
    For the last three only other texts can tell whether the last word is whole.
    """
    text = _FOOT.sub("", text).rstrip()
    paras = re.split(r"\n[ \t]*\n", text)
    lines = paras[-1].split("\n")
    last = lines[-1]
    word = last.rsplit(None, 1)[-1] if last.strip() else ""
    first = 1 if len(paras) > 1 and all(_HEADER.match(x) for x in paras[0].strip().split("\n")) else 0
    if len(paras) == 1 and text and all(_HEADER.match(x) for x in lines):
        return "open", word
    if last.endswith("…") or (len(lines) > 1 and last[:1] == " " and _STAT_LINE.match(lines[-2])):
        return "open", word
    if _STAT_LINE.match(last) or last.strip() == "---" or (last[:1] == " " and last[:2] != "  " and len(paras) > 1 and last.strip() and " " not in last.strip()):
        return "open", word
    if len(last) >= 4 and _OPEN_DIFF.startswith(last):
        return "open", word
    if _DONE.search(last):
        return "done", word
    style = _columns(lines) or _program(lines)
    if style:
        return style, word
    if len(paras) - 1 <= first and not _BULLET.match(last):
        prose = len(paras[-1].strip()) >= PROSE and len(_INNER_END.findall(paras[-1])) > 1
        return ("open" if prose else "title"), word
    if last.strip().startswith("(") or (last.strip().startswith("[") and len(lines) == 1):
        return ("done" if last.rstrip().endswith((")", "]")) else "open"), word
    if any(x.strip() == "Conflicts:" for x in lines):
        return ("done" if re.search(r"\.[A-Za-z0-9]{1,8}$", last) else "open"), word
    if _TRAILER.match(last):
        done = _trailer_done(last)
        return ("trailer" if done is None else "done" if done else "open"), word
    if re.match(r"\s*[A-Z][a-z]+(?:-[a-z]+)+:?$", last):
        return "open", word
    if _BULLET.match(last):
        return "bullet", word
    return ("done" if _short_units(paras, lines) else "open"), word


def lengths(text: str) -> list[int]:
    """The length under each of ``MEASURES``."""
    n = len(text)
    raw = n if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    wide = n if raw == n else n + sum(1 for c in text if c > "￿")
    entity = n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * text.count('"') + 4 * text.count("'")
    crlf, lf, cr = text.count("\r\n"), text.count("\n"), text.count("\r")
    escaped = n + lf + cr + text.count("\t") + text.count('"') + text.count("\\")
    return [n, raw, wide, entity, escaped, n + lf - crlf, n - crlf]


_KERNEL = "doc_id bigint, source string, copy bigint, state string, word string, known array<string>, " + ", ".join(f"{m} int" for m in MEASURES)


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("copy", pa.int64()), ("state", pa.string()), ("word", pa.string()), ("known", pa.list_(pa.string()))]
        + [(m, pa.int32()) for m in MEASURES]
    )
    ends = re.compile(r"^[ \t]*(?:[-*] .*|[A-Z][a-z]+-by: .*)(?=\n)", re.M)
    for batch in batches:
        state, word, known, sizes = [], [], [], []
        for text in batch.column(3).to_pylist():
            plain = text.replace("\r\n", "\n") if "\r" in text else text
            s = diff_state(plain)
            if s is None:
                s, w = message_state(plain)
                known.append(sorted({x.rsplit(None, 1)[-1] for x in ends.findall(plain)}))
                word.append(w)
            else:
                word.append(None)
                known.append([])
            state.append(s)
            sizes.append(lengths(text))
        cols = list(zip(*sizes)) if sizes else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(state, pa.string()), pa.array(word, pa.string()), pa.array(known, pa.list_(pa.string())), *[pa.array(c, pa.int32()) for c in cols]], schema=schema
        )


def plain_source(source: Column) -> Column:
    """Source names without white space around them and in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit(""))


def inspected(documents: DataFrame) -> DataFrame:
    """Length measures and the state of the ending of every document with a text."""
    rows = documents.where("text is not null and text <> ''").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), plain_source(F.col("source")).alias("source"), F.xxhash64("text").alias("copy"), "text"
    )
    return rows.mapInArrow(_inspect, _KERNEL)


def hidden_limits(seen: DataFrame) -> DataFrame:
    """Lengths at which a source cuts: ``source, measure, length, texts``.

    A limit holds at least ``LEAST_AT_LIMIT`` distinct texts and ``LIMIT_RATIO`` times what the
    ``NEIGHBOURS`` lengths to either side hold on average, and at least ``LEAST_OPEN`` of them have
    an unfinished ending; messages that a machine writes pile up too, but are finished. A pile of texts shows in several
    measures; a source cuts by the one with its largest pile, then by the earlier one.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("measure"), F.col(m).alias("length")) for i, m in enumerate(MEASURES)])).alias("x")
    texts = seen.groupBy("source", "copy").agg(F.max(F.col("state").isin("open", "bullet").cast("int")).alias("open"), *[F.max(m).alias(m) for m in MEASURES])
    counts = texts.select("source", "open", stack).groupBy("source", "x.rank", "x.measure", "x.length").agg(F.count("*").alias("texts"), F.avg("open").alias("open"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    counts = counts.withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / (2 * NEIGHBOURS))
    around = F.col("around")
    spike = (F.col("open") >= LEAST_OPEN) & (F.col("texts") >= LEAST_AT_LIMIT) & (F.col("texts") > LIMIT_RATIO * F.greatest(around, F.lit(0.25)) + 4 * F.sqrt(around))
    spikes = counts.where(spike).select("source", "rank", "measure", "length", "texts")
    chief = spikes.groupBy("source").agg(F.max(F.struct("texts", -F.col("rank"), "measure")).getField("measure").alias("measure"))
    return spikes.join(chief, ["source", "measure"])


def truncation_report(documents: DataFrame) -> DataFrame:
    """Every truncated document: ``doc_id, source, reason, limit_measure, limit_length``.

    ``reason`` is ``limit`` (the text stands at a hidden limit of its source and its ending is
    unfinished) or ``ending`` (a diff, sentence, path, trailer or word breaks off anywhere).
    A finished message is never listed, whatever its length; null and empty texts neither.
    """
    seen = cut(inspected(documents))
    limits = hidden_limits(seen)
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in MEASURES])).alias("x")
    at = seen.where("state <> 'done'").select("doc_id", "source", stack).select("doc_id", "source", "x.measure", F.col("x.n").alias("length"))
    at = at.join(limits, ["source", "measure", "length"])
    best = at.groupBy("doc_id").agg(F.max(F.struct("texts", -F.col("rank"), "measure", "length")).alias("b"))
    best = best.select("doc_id", F.col("b.measure").alias("limit_measure"), F.col("b.length").alias("limit_length"))
    vocabulary = seen.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    doubt = seen.where("state in ('bullet', 'trailer')").select("doc_id", "word").join(vocabulary, "word", "left_anti")
    odd = doubt.select("doc_id", F.lit(True).alias("odd"))
    out = seen.where("state <> 'done'").select("doc_id", "source", "state").join(best, "doc_id", "left").join(odd, "doc_id", "left")
    whole = (F.col("state") == "trailer") & F.col("odd").isNull()
    at_limit = F.col("limit_length").isNotNull() & ~whole
    ending = (F.col("state") == "open") | F.coalesce("odd", F.lit(False))
    return out.where(at_limit | ending).select("doc_id", "source", F.when(at_limit, F.lit("limit")).otherwise(F.lit("ending")).alias("reason"), F.when(at_limit, F.col("limit_measure")).alias("limit_measure"), F.when(at_limit, F.col("limit_length")).alias("limit_length"))


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: documents, truncated ones, the rate, and how many stand at a hidden limit."""
    total = documents.groupBy(plain_source(F.col("source")).alias("source")).agg(F.count("*").alias("documents"))
    found = truncation_report(documents).groupBy("source").agg(F.count("*").alias("truncated"), F.count_if(F.col("reason") == "limit").alias("at_limit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = total.join(found, "source", "left").select("source", "documents", zero("truncated"), zero("at_limit"))
    return out.withColumn("rate", F.col("truncated") / F.col("documents"))
