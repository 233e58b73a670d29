"""Quality rules over blocks and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.operators.prefix import by_size, per_key


def flag_small_text(df: DataFrame, threshold: float = 12) -> DataFrame:
    return df.filter(F.col("font_size") < threshold)


def validate_blocks(df: DataFrame, max_blocks: int = 32, max_text: int = 8192, bound: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with ``reasons``). A page with more than ``max_blocks`` blocks is rejected whole."""
    c, one = F.col, F.count(F.lit(1))

    def whole(d: DataFrame) -> DataFrame:
        return d.withColumn("__same", one.over(Window.partitionBy("page", "block_id"))).withColumn("__page_blocks", one.over(Window.partitionBy("page")))

    def spread(d: DataFrame) -> DataFrame:
        d = per_key(d.withColumn("__id", F.struct("block_id")), ["page", "__id"], one.alias("__same"))  # in a struct, since a row without an id is joined as well
        return per_key(d.drop("__id"), ["page"], one.alias("__page_blocks"))

    d = by_size(df, ["page"], whole, spread)
    box = [c(x).cast("double") for x in ("x1", "y1", "x2", "y2")]
    finite = box[0].isNotNull()
    for b in box:
        finite = finite & b.isNotNull() & ~F.isnan(b) & (F.abs(b) <= bound)
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce((c("block_id") > 0) & (c("block_id") <= 2147483647), F.lit(False)), "bad_id"),
        F.when(c("__same") > 1, "duplicate_id"),
        F.when(tx.is_empty_text(c("text")), "empty_text"),
        F.when(F.length("text") > max_text, "long_text"),
        F.when(~F.coalesce(finite & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False)), "bad_box"),
        F.when(c("__page_blocks") > max_blocks, "page_too_large")))
    d = d.withColumn("reasons", reasons).drop("__page_blocks", "__same")
    return d.filter(F.size("reasons") == 0).drop("reasons"), d.filter(F.size("reasons") > 0)


def split_empty_blocks(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    empty = tx.is_empty_list(F.col(text)) if dict(df.dtypes)[text].startswith("array") else tx.is_empty_text(F.col(text))
    return df.filter(~empty), df.filter(empty)


def own_direction(pieces: Column, lines: Column, aspect: float = 1.6) -> Column:
    """Direction of a block from its own lines: pieces with two letters or more must agree, else null.

    ``lines``: array of structs x1,y1,x2,y2, one per piece.
    """
    def one(p: Column) -> Column:
        w, h = p["l"]["x2"] - p["l"]["x1"], p["l"]["y2"] - p["l"]["y1"]
        return F.when(h >= w * aspect, "v").when(w >= h * aspect, "h").otherwise("?")

    zipped = F.zip_with(pieces, lines, lambda t, l: F.struct(t.alias("t"), l.alias("l")))
    seen = F.array_distinct(F.transform(F.filter(zipped, lambda p: tx.letter_count(p["t"]) >= 2), one))
    sure = (F.size(pieces) == F.size(lines)) & (F.size(seen) == 1) & (F.get(seen, 0) != "?")
    return F.when(sure, F.get(seen, 0) == "v")


def misspelled(words: DataFrame, *dictionaries: DataFrame) -> DataFrame:
    """Words (column ``word``) in none of the dictionaries (column ``word``); words with other characters are ignored."""
    d = words.withColumn("lower", F.lower("word")).filter(F.col("lower").rlike(r"^\p{L}+$"))
    for known in dictionaries:
        d = d.join(known.select(F.lower("word").alias("lower")).distinct(), "lower", "left_anti")
    return d


def _deletions(c: Column, n: int) -> Column:
    """The word and all its forms with up to ``n`` letters removed."""
    forms = F.array(c)
    for _ in range(n):
        forms = F.array_distinct(F.flatten(F.transform(forms, lambda w: F.concat(F.array(w), F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))))
    return forms


def suggestions(words: DataFrame, dictionary: DataFrame, distance: int = 2, limit: int = 5, max_length: int = 15) -> DataFrame:
    """At most ``limit`` dictionary words within the edit distance, nearest first; none for long words.

    Two words within distance d share a form with at most d letters removed, so candidates come from a hash join
    on such forms, never from comparing all words with all entries.
    """
    w = words.select(F.lower("word").alias("word")).distinct().filter(F.length("word") <= max_length)
    e = dictionary.select(F.lower("word").alias("entry"), "rank").filter(F.length("entry") <= max_length + distance)
    cand = (w.select("word", F.explode(_deletions(F.col("word"), distance)).alias("form"))
            .join(e.select("entry", "rank", F.explode(_deletions(F.col("entry"), distance)).alias("form")), "form")
            .select("word", "entry", "rank").distinct())
    cand = cand.withColumn("distance", F.levenshtein("word", "entry")).filter((F.col("distance") <= distance) & (F.col("word") != F.col("entry")))
    from pagetext.operators.terms import first_n

    return first_n(cand, ["word"], [F.col("distance"), F.col("rank"), F.col("entry")], limit)


# Labelled patterns of secrets, blocked path parts and file suffixes. One part is left out, since it names a project.
SECRET_PATTERNS = {
    "private user path": r"(?i)[A-Za-z]:[\\/]+Users[\\/]+(?!Public(?:[\\/]|$))[^\\/\s\"<>]+",
    "GitHub token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "Hugging Face token": r"hf_[A-Za-z0-9]{30,}",
    "OpenAI-like secret": r"sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
BLOCKED_PARTS = (".venv", "venv", "ollama-models", "runtime", "__pycache__", ".env")
BLOCKED_SUFFIXES = (".gguf", ".safetensors", ".pth", ".pt", ".onnx", ".pkl", ".npz", ".log", ".bak", ".exe", ".dll", ".pyd", ".pyc", ".part")
MAX_BYTES = 20 * 1024 * 1024


def scan_secrets(df: DataFrame, key: str, text: str = "text", path: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: key and reason. The matched value never leaves the row."""
    found = [F.when(F.col(text).rlike(p), name) for name, p in {**SECRET_PATTERNS, **(extra or {})}.items()]
    found.append(F.when(F.octet_length(text) > MAX_BYTES, "unexpected large release file"))
    if path:
        parts, lower = F.split(path, r"[/\\]"), F.lower(path)
        bad = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in BLOCKED_PARTS]))
        for s in BLOCKED_SUFFIXES:
            bad = bad | lower.endswith(s)
        found.append(F.when(bad, "runtime/model/private file class"))
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("reason"))
