"""Spoken cues of subtitle texts, as folded words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_TIMING = re.compile(r"--\s?>|—>|-->|–>")
_TAGS = re.compile(r"<[^>]*>|\{\\[^}]*\}")
_SOUND = re.compile(r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|\*[^*]*\*|♪[^♪]*♪?|#[^#]*#")
_MARKS = re.compile(r"[<\[({*♪#]")
_SPEAKER = re.compile(r"^\s*(?:>>\s*)?[-–]?\s*(?:[^\W\d_]{2,}(?: [^\W\d_]{2,})?:(?=\s))?")
#: the end of a web address; what it starts with is looked up backwards, so that most dots cost one comparison
_DOMAIN = re.compile(r"\.[a-z]{2,}\b")
#: words by which subtitles name themselves; a choice of this module. Other adverts are known by their web address; most
#: words of those without one are of no subject in the lexicon, as they are spread over documents of all subjects.
_CREDITS = re.compile(r"subtit|untertitel|sous-titre|subtítul", re.I)
_WORD = re.compile(r"[a-z]{2,}")
#: what character recognition confuses is written alike (fixed values)
_FOLD = str.maketrans({"l": "i", "1": "i", "|": "i", "0": "o", "5": "s", "e": "c"})
#: letters that don't decompose (fixed values)
_PLAIN = str.maketrans({"ß": "s", "æ": "a", "œ": "o", "ø": "o"})


@lru_cache(1 << 17)
def folded(word: str) -> str:
    w = word.lower()
    if not w.isascii():  # accents go, and so do other scripts, of which no word is kept
        w = unicodedata.normalize("NFKD", w.translate(_PLAIN)).encode("ascii", "ignore").decode()
    w = w.replace("rn", "m").replace("cl", "d").replace("vv", "w").translate(_FOLD)
    return " ".join(_WORD.findall(w))


def repaired(text: str) -> str:
    """Undo UTF-8 that was read as a single-byte encoding, where all of it can be undone."""
    if "Ã" in text or "â€" in text or "Â" in text:
        for name in ("cp1252", "latin-1"):
            try:
                return text.encode(name).decode("utf-8")
            except UnicodeError:
                continue
    return text


@lru_cache(1 << 16)
def spoken_words(body: str) -> str | None:
    """Folded words of one cue's text; None for sound descriptions, adverts and empty cues."""
    if _CREDITS.search(body) or hosts(body):
        return None
    lines = body.split("\n")
    if _MARKS.search(body):
        lines = [_SOUND.sub(" ", _TAGS.sub("", x)) for x in lines]
    words = folded(" ".join([_SPEAKER.sub("", x) for x in lines]))
    return words or None


def cues(text: str | None) -> list[str]:
    """The texts of all cues, in file order; what is before the first timing line, numbers and notes are left out."""
    if not text:
        return []
    out, inside, lines = [], False, []
    for line in repaired(text).replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if ">" in line and _TIMING.search(line):
            if lines:
                out.append("\n".join(lines))
            inside, lines = True, []
        elif not line.strip():
            if lines:
                out.append("\n".join(lines))
            inside, lines = False, []
        elif inside:
            lines.append(line)
    if lines:
        out.append("\n".join(lines))
    return out


def hosts(text: str | None) -> set[str]:
    """Folded words of the web addresses in a text, from each address's start on; each character is looked at once."""
    found, start, seen, done = set(), 0, 0, 0
    for m in _DOMAIN.finditer(text or ""):
        i = at = m.start()
        while i > seen and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
            i -= 1
        if i > seen:  # else it goes on from the dot before
            start = i
        seen = at
        if start < at and text[at - 1] != ".":
            found.update(folded(re.sub(r"[\W\d_]+", " ", text[max(start, done) : m.end()])).split())
            done = m.end()
    return found
