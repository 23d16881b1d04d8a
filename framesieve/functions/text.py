"""Text expressions that stay in the JVM, and their Python twins for Arrow functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of Unicode letters and digits.
WORD = r"[\p{L}\p{Nd}]+"
#: The ASCII punctuation characters (fixed value).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_PY = re.compile(r"[^\W_]+")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """Array of the words of the lower-cased text; null stays null."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def _plain(word: str) -> bool:
    return word.isascii() or all(x.isalpha() or x.isdecimal() for x in word)


def py_words(text: str | None) -> list[str]:
    """words() in Python. Number signs that are neither letters nor decimal digits separate words here too."""
    if not text:
        return []
    found = _WORD_PY.findall(text.lower())
    if all(map(_plain, found)):
        return found
    return "".join(x if x.isalpha() or x.isdecimal() else " " for x in text.lower()).split()

#: What stands in for a missing caption, and the synthesis prompt.
NO_CAPTION = "no caption generated"
NO_CAPTIONS = "[no captions generated]"
NO_SUMMARY = "No visual information available."
NO_ANSWER = "Failed to generate caption."
PROMPT = (
    "You are an automated video captioning system. Your ONLY job is to synthesize the provided visual frame descriptions "
    "and audio transcripts into a single, declarative sentence.\n\nSTRICT RULES:\n1. Output EXACTLY ONE sentence.\n"
    '2. NEVER use conversational filler (Do NOT say "The video shows", "Here is a summary", "In this clip").\n'
    "3. Describe only the literal action occurring.\n4. Maximum length: 15 words.\n\n"
    "Visual Summary: %s\nAudio Transcript: %s\n\nCaption:"
)


def token_list(c: str | Column, contractions: bool = False) -> Column:
    """Tokens of the lower-cased text without ASCII punctuation, split at white space, in order. With contractions,
    words such as cannot, gonna and wanna are two tokens each."""
    plain = F.translate(F.lower(col(c)), PUNCTUATION, "")
    if contractions:
        plain = F.regexp_replace(plain, r"\b(can)(not)\b", "$1 $2")
        plain = F.regexp_replace(plain, r"\b(gim|lem)(me)\b", "$1 $2")
        plain = F.regexp_replace(plain, r"\b(gon|wan)(na)\b", "$1 $2")
        plain = F.regexp_replace(plain, r"\b(got)(ta)\b", "$1 $2")
    return F.filter(F.split(plain, r"\s+"), lambda x: x != "")


def token_set(c: str | Column, contractions: bool = False) -> Column:
    """Distinct tokens of token_list()."""
    return F.array_distinct(token_list(c, contractions))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared part of two token sets; 0.0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def squeeze(c: str | Column) -> Column:
    """White space trimmed, and inner runs of it made one space."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def or_placeholder(c: str | Column, placeholder: str) -> Column:
    """The squeezed text, or the placeholder where it is null or blank."""
    return F.coalesce(F.nullif(squeeze(c), F.lit("")), F.lit(placeholder))


def corpus_tokens(c: str | Column, lower: bool = True) -> Column:
    """Tokens of a text split at white space; punctuation stays. A blank text has none."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.filter(F.split(F.lower(text) if lower else text, " "), lambda x: x != "")


def ngrams(tokens: str | Column, n: int) -> Column:
    """Contiguous n-grams, joined by one space; none where there are fewer than n tokens."""
    tokens = col(tokens)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngrams_to(tokens: str | Column, most: int = 4) -> Column:
    """Array of struct(n, gram) for n from 1 to most."""

    def sized(n: int) -> Column:
        return F.transform(ngrams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    return F.concat(*map(sized, range(1, most + 1)))


def cache_key(video: str | Column, method: str | Column, model: str, revision: str) -> Column:
    """Name under which captions of a video are kept. A model without revision is an error: old captions would be taken for new."""
    if not revision:
        raise ValueError("revision must not be empty")
    return F.concat_ws("_", col(video), col(method), *(F.translate(F.lit(x), "/: ", "___") for x in (model, revision)))


def final_prompt(aggregated: str | Column, n_captions: str | Column, transcript: str | Column, mode: str | Column) -> Column:
    """What a video's captions become: a placeholder without captions, the aggregated caption itself, or a prompt."""
    summary = F.coalesce(F.nullif(F.trim(col(aggregated)), F.lit("")), F.lit(NO_SUMMARY))
    prompt = F.format_string(PROMPT, summary, F.coalesce(col(transcript), F.lit("")))
    return F.when(F.coalesce(col(n_captions), F.lit(0)) == 0, NO_CAPTIONS).when(col(mode) == "vlm_only", col(aggregated)).otherwise(prompt)


def final_caption(prompt: str | Column, answer: str | Column, mode: str | Column) -> Column:
    """The prompt itself in vlm_only mode, else the model's answer or a placeholder."""
    return F.when(col(mode) == "vlm_only", col(prompt)).otherwise(F.coalesce(F.nullif(F.trim(col(answer)), F.lit("")), F.lit(NO_ANSWER)))
