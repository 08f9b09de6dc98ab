"""Fill-in-middle transformation: documents cut at two units and put in another order around sentinels.

A unit is a word with the white space before it; white space at the end of a text is a unit of
its own. One Aho-Corasick automaton walks a text once and stops only at the ASCII characters
that end a word, white space, and at sentinels. Between two stops one behind the other there is
no word, in a wider gap there is exactly one, so counting gaps counts units, and the end of unit
r is the stop behind the r-th gap: no other character is looked at.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import in_small_batches

#: The sentinels, and the characters that are white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = " \t\n\x0b\f\r"
SEED = 42
#: Percent of documents that are transformed, and of these in the order suffix, prefix, middle.
PERCENT = 50
SPM_PERCENT = 80


def automaton() -> ahocorasick.Automaton:
    """Stops at white space with 0 and at sentinels with 1."""
    found = ahocorasick.Automaton()
    for key in SPACES:
        found.add_word(key, 0)
    for key in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(key, 1)
    found.make_automaton()
    return found


def word_ends(text: str, stops: ahocorasick.Automaton) -> tuple[np.ndarray, int, bool]:
    """Where each word ends, the number of units, and whether a sentinel occurs."""
    events = np.fromiter((2 * at + kind for at, kind in stops.iter(text)), np.int64)
    spaces = np.append(events[events & 1 == 0] >> 1, len(text))
    ends = spaces[np.diff(spaces, prepend=-1) > 1]
    trailing = len(spaces) > 1 and spaces[-2] == len(text) - 1
    return ends, len(ends) + trailing, bool((events & 1).any())


def draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, key: str, stops: ahocorasick.Automaton, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output) of one text."""
    ends, n, marked = word_ends(text, stops)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or marked or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = (0 if r == 0 else len(text) if r > len(ends) else int(ends[r - 1]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs(doc_id, text).

    Null texts are empty texts; these and texts that hold a sentinel stay plain, with null
    prefix_chars and middle_chars. Draws depend on seed and doc_id alone (a null one counts as
    an empty string), so repeated rows are transformed alike and reruns agree. A text is cut in
    one task however long it is. Other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")

    def run(batches):
        stops = automaton()
        for batch in batches:
            found = [transformed(t or "", k, stops, seed, percent, spm_percent) for t, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            n, form, before, between, output = zip(*found, strict=True) if found else ((),) * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return in_small_batches(rows, run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; it is told from output and form alone.

    No text that is transformed holds a sentinel, and a sentinel's last character is only at
    sentinels' ends, so each is found by its first place.
    """
    first, last = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output)), F.locate(MIDDLE, output)
    one = F.substring(output, F.lit(4), first - 4)
    two = F.substring(output, first + 3, last - first - 3)
    middle = F.substring(output, last + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
