"""Sentence-pair corpora from annotation files and learner entries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textfix.functions.edits import apply_edits
from textfix.functions.similarity import word_edits
from textfix.functions.text import WS, let, strip, word_count, words
from textfix.operators.ordering import CHUNK_ROWS, first_rows, previous_value
from textfix.session import computed_once

EDIT_TYPE = "struct<start:int,end:int,seq:bigint,repl:string>"
# A whole number as the source format allows it: sign, digits, single underscores between digits.
WHOLE_NUMBER_RE = rf"^[{WS}]*[+\-]?[0-9]+(_[0-9]+)*[{WS}]*\z"
AT_LEAST_ONE_RE = rf"^[{WS}]*\+?[0-9_]*[1-9]"


def _note(line: Column) -> Column:
    """Fields of an annotation line, split once: STRUCT<kind, start, end, repl, who>; numbers may be NULL."""

    def read(fields: Column) -> Column:
        return let(
            words(F.get(fields, F.lit(0))),
            lambda span: F.struct(
                F.get(fields, F.lit(1)).alias("kind"),
                F.get(span, F.lit(0)).try_cast("int").alias("start"),
                F.get(span, F.lit(1)).try_cast("int").alias("end"),
                F.get(fields, F.lit(2)).alias("repl"),
                strip(F.get(fields, F.lit(5))).try_cast("int").alias("who"),
            ),
        )

    return let(F.split(F.substr(line, F.lit(3)), r"\|\|\|", -1), read)


def _edit(note: Column, seq: Column, annotator: int) -> Column:
    wanted = (note["kind"] != "noop") & (note["start"] >= 0) & (note["who"] == annotator)
    return F.when(
        wanted,
        F.struct(
            note["start"].alias("start"), note["end"].alias("end"), seq.cast("long").alias("seq"),
            note["repl"].alias("repl"),
        ),
    )


def _bad(note: Column) -> Column:
    return note["start"].isNull() | note["end"].isNull() | note["who"].isNull()


def parse_edit(line: Column, seq: Column, annotator: int = 0) -> Column:
    """One annotation line as an edit; NULL for no-ops and other annotators."""
    return let(_note(line), lambda note: _edit(note, seq, annotator))


def is_malformed(line: Column) -> Column:
    """Whether an annotation line lacks a whole number as start, end or annotator."""
    return let(_note(line), _bad)


def m2_blocks(
    lines: DataFrame, annotator: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Assemble annotation lines (file, line_no, line) into blocks.

    Result: (file, block, src, edits, broken); ``block`` is the line number of the sentence. A block
    ends at a blank line or at the end of the file; one that meets a new sentence first is dropped.
    ``broken`` marks blocks with a malformed annotation line, which give no pair.
    """
    line = F.col("line")
    kind = (
        F.when(line.startswith("S "), "S").when(line.startswith("A "), "A").when(strip(line) == "", "B")
    )
    marked = lines.withColumn("kind", kind).where(F.col("kind").isNotNull())
    event = F.when(F.col("kind") != "A", F.struct(F.col("line_no").alias("at"), "kind"))
    linked = previous_value(marked, "line_no", event, "prev", ["file"], chunk_rows)
    # NULL where a line lies in no block.
    linked = computed_once(
        linked, "_note", F.when((F.col("kind") == "A") & (F.col("prev.kind") == "S"), _note(line))
    )
    note, block = F.col("_note"), F.col("prev.at")
    noted = computed_once(
        linked, "_read",
        F.struct(_edit(note, F.col("line_no"), annotator).alias("edit"), _bad(note).alias("bad")),
    )
    no_edit, no_text = F.lit(None).cast(EDIT_TYPE), F.lit(None).cast("string")

    def part(block: Column, src: Column, edit: Column, cut: Column, bad: Column) -> Column:
        return F.struct(
            block.alias("block"), src.alias("src"), edit.alias("edit"), cut.alias("cut"), bad.alias("bad"),
        )

    fine, edit, bad = F.lit(False), F.col("_read.edit"), F.col("_read.bad")
    # A block is its sentence; besides go only the lines that change it: edits, bad lines, and a sentence
    # that comes before a blank line.
    parts = F.array(
        F.when(F.col("kind") == "S", part(F.col("line_no"), line, no_edit, fine, fine)),
        F.when((F.col("kind") == "S") & (F.col("prev.kind") == "S"), part(block, no_text, no_edit, F.lit(True), fine)),
        F.when(note.isNotNull() & (edit.isNotNull() | bad), part(block, no_text, edit, fine, bad)),
    )
    return (
        noted.select("file", F.explode(parts).alias("p"))
        .where(F.col("p").isNotNull())
        .groupBy("file", F.col("p.block").alias("block"))
        .agg(
            F.max("p.src").alias("_src"),
            F.collect_list("p.edit").alias("edits"),
            F.max("p.cut").alias("_cut"),
            F.max("p.bad").alias("broken"),
        )
        .where(~F.col("_cut"))
        .select("file", "block", words(F.substr("_src", F.lit(3))).alias("src"), "edits", "broken")
    )


def blocks_from_text(blocks: DataFrame, annotator: int = 0) -> DataFrame:
    """The same from whole blocks (file, block, value), one ``S`` line each; nothing is shuffled."""
    split = computed_once(blocks, "_lines", F.split("value", r"\r?\n", -1))
    notes = F.transform("_lines", lambda x: F.when(x.startswith("A "), _note(x)))
    first = F.get(F.filter("_lines", lambda x: x.startswith("S ")), F.lit(0))
    read = computed_once(split, "_read", F.struct(notes.alias("notes"), first.alias("first")))
    edits = F.transform("_read.notes", lambda n, i: F.when(n.isNotNull(), _edit(n, i, annotator)))
    return read.where(F.col("_read.first").isNotNull()).select(
        "file", "block", words(F.substr("_read.first", F.lit(3))).alias("src"),
        F.array_compact(edits).alias("edits"),
        F.exists("_read.notes", lambda n: n.isNotNull() & _bad(n)).alias("broken"),
    )


def m2_pairs(blocks: DataFrame) -> DataFrame:
    """Rebuild (file, block, src, tgt) by applying the edits of each block that is not broken."""
    both = F.struct(
        F.array_join("src", " ").alias("src"),
        F.array_join(apply_edits(F.col("src"), F.col("edits")), " ").alias("tgt"),
    )
    rebuilt = computed_once(blocks.where(~F.col("broken")), "_pair", both)
    return rebuilt.select("file", "block", "_pair.src", "_pair.tgt")


def valid_pairs(pairs: DataFrame, keep_identity: bool = False) -> DataFrame:
    kept = pairs.where((strip(F.col("src")) != "") & (strip(F.col("tgt")) != ""))
    return kept if keep_identity else kept.where(F.col("src") != F.col("tgt"))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "tgt").distinct()


def first_occurrence(pairs: DataFrame, order: str | Column) -> DataFrame:
    """One row per distinct pair with its first place in the input, as ``line_no``."""
    return pairs.groupBy("src", "tgt").agg(F.min(order).alias("line_no"))


def length_ratio(pairs: DataFrame, max_ratio: float = 3.0) -> DataFrame:
    """Keep pairs whose word counts differ at most by a factor, both ways, and are not zero."""
    counts = F.struct(word_count(F.col("src")).alias("s"), word_count(F.col("tgt")).alias("t"))
    counted = computed_once(pairs, "_n", counts)
    ls, lt = F.col("_n.s"), F.col("_n.t")
    kept = counted.where((ls > 0) & (lt > 0) & (lt <= max_ratio * ls) & (ls <= max_ratio * lt))
    return kept.drop("_n")


def minimal_edit(pairs: DataFrame, max_edits: int) -> DataFrame:
    """Keep pairs that change at most ``max_edits`` words; 0 keeps all."""
    if not max_edits:
        return pairs
    counted = computed_once(pairs, "_edits", word_edits(F.col("src"), F.col("tgt")))
    return counted.where(F.col("_edits") <= max_edits).drop("_edits")


def prepare_m2(blocks: DataFrame, keep_identity: bool = False) -> DataFrame:
    """Distinct valid pairs of annotated blocks, each with its first place as ``line_no``."""
    kept = valid_pairs(m2_pairs(blocks), keep_identity)
    return first_occurrence(kept, F.struct("file", "block"))


@dataclass(frozen=True)
class PrepCounters:
    """Counters of a preparation job, filled by the first action on its pairs."""

    seen: Observation
    kept: Observation

    def get(self) -> dict[str, int]:
        """``identities``, ``broken`` and ``pairs``; waits for the job's write."""
        return {k: int(v or 0) for k, v in (self.seen.get | self.kept.get).items()}


def prepare_m2_counted(blocks: DataFrame, keep_identity: bool = False) -> tuple[DataFrame, PrepCounters]:
    """:func:`prepare_m2` and its counters, which come with the write of the pairs: no second pass."""
    counters = PrepCounters(Observation(), Observation())
    made = F.when(~F.col("broken"), apply_edits(F.col("src"), F.col("edits")))
    both = F.struct(F.array_join("src", " ").alias("src"), F.array_join(made, " ").alias("tgt"))
    rebuilt = computed_once(blocks, "_pair", both).select("file", "block", "broken", "_pair.src", "_pair.tgt")
    usable = ~F.col("broken") & (strip(F.col("src")) != "") & (strip(F.col("tgt")) != "")
    seen = rebuilt.observe(
        counters.seen,
        F.count_if(usable & (F.col("src") == F.col("tgt"))).alias("identities"),
        F.count_if("broken").alias("broken"),
    )
    kept = valid_pairs(seen.where(~F.col("broken")).drop("broken"), keep_identity)
    pairs = first_occurrence(kept, F.struct("file", "block"))
    return pairs.observe(counters.kept, F.count(F.lit(1)).alias("pairs")), counters


def prepare_lang8_counted(
    lines: DataFrame, keep_identity: bool = False, max_ratio: float = 3.0, max_edits: int = 0
) -> tuple[DataFrame, PrepCounters]:
    """:func:`prepare_lang8` without a limit, and its counters; ``broken`` are lines that give no entry."""
    counters = PrepCounters(Observation(), Observation())
    entries = entry_columns(lines)
    usable = F.col("entry") & (F.col("src") != "") & (F.col("tgt") != "")
    seen = entries.observe(
        counters.seen,
        F.count_if(usable & (F.col("src") == F.col("tgt"))).alias("identities"),
        F.count_if(~F.col("entry")).alias("broken"),
    )
    pairs = valid_pairs(seen.where("entry").drop("entry"), keep_identity)
    kept = minimal_edit(first_occurrence(length_ratio(pairs, max_ratio), "line_no"), max_edits)
    return kept.observe(counters.kept, F.count(F.lit(1)).alias("pairs")), counters


def prep_counters(
    blocks: DataFrame, keep_identity: bool = False, files: DataFrame | None = None
) -> DataFrame:
    """Files read, distinct pairs kept, identical pairs seen (before dropping and dedup), and blocks
    dropped as broken.

    ``files`` (file) names all files read, those without a block included; by default the files of
    the blocks are counted.
    """
    pairs = m2_pairs(blocks)
    usable = valid_pairs(pairs, keep_identity=True)
    seen = usable.agg(F.count_if(F.col("src") == F.col("tgt")).alias("identities"))
    kept = distinct_pairs(valid_pairs(pairs, keep_identity)).agg(F.count(F.lit(1)).alias("pairs"))
    read = (blocks if files is None else files).agg(F.countDistinct("file").alias("files"))
    broken = blocks.agg(F.count_if(F.col("broken")).alias("broken"))
    one = [x.withColumn("_one", F.lit(1)) for x in (read, broken, kept, seen)]
    return reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")


def entry_columns(lines: DataFrame) -> DataFrame:
    """Learner lines as (line_no, src, tgt, entry); ``entry`` says whether there is a correction."""
    split = computed_once(lines, "_cols", F.split("line", "\t", -1))
    cols = F.col("_cols")
    count = F.get(cols, F.lit(0))
    entry = (F.size(cols) >= 6) & count.rlike(WHOLE_NUMBER_RE) & count.rlike(AT_LEAST_ONE_RE)
    read = F.struct(
        strip(F.get(cols, F.lit(4))).alias("src"),
        strip(F.get(cols, F.lit(5))).alias("tgt"),
        F.coalesce(entry, F.lit(False)).alias("entry"),
    )
    return computed_once(split, "_e", read).select("line_no", "_e.src", "_e.tgt", "_e.entry")


def parse_lang8(lines: DataFrame, keep_identity: bool = False) -> DataFrame:
    """Learner entries (line_no, line) with at least one correction: (line_no, src, tgt)."""
    return valid_pairs(entry_columns(lines).where("entry").drop("entry"), keep_identity)


def prepare_lang8(
    lines: DataFrame,
    keep_identity: bool = False,
    max_ratio: float = 3.0,
    max_edits: int = 0,
    limit: int = 0,
) -> DataFrame:
    """Distinct filtered pairs in input order (``line_no``); the costly filter runs last."""
    pairs = length_ratio(parse_lang8(lines, keep_identity), max_ratio)
    kept = minimal_edit(first_occurrence(pairs, "line_no"), max_edits)
    return first_rows(kept, "line_no", limit) if limit else kept


def mix_corpora(clean: DataFrame, noisy: DataFrame, cap: int, order: str = "line_no") -> DataFrame:
    """Append the first ``cap`` pairs of a noisy corpus to a clean one; duplicates are kept."""
    return clean.select("src", "tgt").unionByName(first_rows(noisy, order, cap).select("src", "tgt"))
