"""Plain versions of the operators' contracts, and awkward rows."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def awkward_texts():
    long = " ".join(f"w{i % 977}x{i}" for i in range(9000))
    return [
        None, "", " \n\t ", "one", "a b c d", "a b c d e", "É x y\x85z w\x0bv\x0cu",
        "same line here\nsame line here\n\nsame line here \nother\n", "a b " * 60, "x" * 3000, long, long + " tail", long,
        "The quick brown fox jumps over the lazy dog again and again until night. " * 3, "\n\n a\nb\na\n", "# * $ % & | < > a",
        "Licensed under CC BY cc by, General Public License. ALL rights-reserved", "日本語 テキスト 日本語", "emoji 😀 family 👨‍👩‍👧", "tail\\",
        "<|endoftext|> a <|startoftext|><|endoftext|>", "don't we'll I'M  x\r\n\r\n  y   ", "é ﬁ Σ ΑΣ İ ß 12³½ a_b",
    ]


def docs_frame(spark, texts, start=0, extra=False):
    rows = [(start + i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }
