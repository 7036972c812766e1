"""Problem 7: text garbled by a wrong character encoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_type, hash_sample, map_arrow, matching, table

#: Sampled ids whose values the dictionaries are trained on, and the size of a dictionary.
TRAIN_ROWS, DICT_BYTES = 6000, 64 * 1024
#: Description length in bytes of a decoding step, told once per value: chance alone seldom makes valid UTF-8, a code of single letters often.
STEP_BYTES = {"cp1252>utf-8": 1.0, "mac_roman>utf-8": 1.0, "cp1252>tcvn3": 1.0, "cp1252>tcvn3 words": 1.0}
#: Decoding steps of a chain, at most.
MAX_STEPS = 3

#: The single-byte Vietnamese code of TCVN 5712 (lower and upper case), as Windows-1252 shows it.
_TCVN_BYTES = [*range(0xA1, 0xAF), *range(0xB5, 0xBA), *range(0xBB, 0xBF), *range(0xC6, 0xCD), *range(0xCE, 0xD9), *range(0xDC, 0xE0), *range(0xE1, 0xF0), *range(0xF1, 0xFF)]
_TCVN_LETTERS = "ĂÂÊÔƠƯĐăâêôơưđ" "àảãáạ" "ằẳẵắ" "ặầẩẫấậè" "ẻẽéẹềểễếệìỉ" "ĩíịò" "ỏõóọồổỗốộờởỡớợù" "ủũúụừửữứựỳỷỹýỵ"
TCVN = {b: c for b, c in zip(_TCVN_BYTES, _TCVN_LETTERS, strict=True)}


def _byte_table(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte codec; bytes it leaves open stand for the control character of that number, as lenient decoders do."""
    out = {chr(b): b for b in range(128, 256)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


_CODECS = {"cp1252": _byte_table("cp1252"), "mac_roman": {c: b for c, b in _byte_table("mac_roman").items() if not ("\x80" <= c <= "\x9f")}}


def _class(chars) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(chars)) + "]"


def _sequences(codec: str) -> str:
    """Pattern of the characters that are one multi-byte UTF-8 character, seen through ``codec``."""
    at = _CODECS[codec]
    tail = _class(c for c, b in at.items() if 0x80 <= b <= 0xBF)
    lead = [_class(c for c, b in at.items() if lo <= b <= hi) for lo, hi in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))]
    return f"(?:{lead[0]}{tail}|{lead[1]}{tail}{{2}}|{lead[2]}{tail}{{3}})"


_UTF8 = {codec: re.compile(_sequences(codec) + "+") for codec in _CODECS}
_TCVN_SEEN = {bytes([b]).decode("cp1252"): c for b, c in TCVN.items()}
#: Characters of that code which ordinary Vietnamese and English text doesn't have.
_TCVN_ODD = "".join(c for c in _TCVN_SEEN if c not in "àáâãèéêìíòóôõùúýÂÊÔÃÀÁÈÉÌÍÒÓÕÙÚÝ")
_TCVN_WORD = re.compile(f"[^\\W\\d_]{_class(_TCVN_ODD)}|{_class(_TCVN_ODD)}[^\\W\\d_]")
#: Question marks that no writing has: inside a word, before a lower-case word, or alone before one; links aside.
_LOST = re.compile(r"[^\W\d_]\?+[^\W\d_]|(?:^|(?<=[\s(\"“-]))\?+[^\W\d_]|(?<=\s)\?(?=\s+[^\W\d_])", re.MULTILINE)
_LINK = re.compile(r"://|[=&/]")

#: Values without a match have no other decoding and lost nothing; for Java's patterns, and the same for Arrow's.
SUSPECT = "|".join([*(_sequences(c) for c in _CODECS), _class(_TCVN_ODD), "\\ufffd", r"\?"])
_MAYBE = re.sub(r"\\u([0-9a-f]{4})", lambda m: c if (c := chr(int(m[1], 16))).isalnum() or ord(c) > 127 else "\\" + c, "|".join([*(_sequences(c) for c in _CODECS), _class(_TCVN_ODD), "\ufffd", r"\?\pL", r"\s\?\s"]))


def _decode_utf8(codec: str, text: str) -> str:
    at = _CODECS[codec]

    def run(m: re.Match) -> str:
        try:
            return bytes(at[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _UTF8[codec].sub(run, text)


def _decode_tcvn(text: str) -> str:
    return "".join(_TCVN_SEEN.get(c, c) for c in text)


_TCVN_TOKEN = re.compile(f"\\S*{_class(_TCVN_ODD)}\\S*")


def _decode_tcvn_words(text: str) -> str:
    """Only the words that have an odd character; for clean text with garbled words in it."""
    return _TCVN_TOKEN.sub(lambda m: _decode_tcvn(m.group()), text)


STEPS: dict[str, Callable[[str], str]] = {
    "cp1252>utf-8": lambda t: _decode_utf8("cp1252", t),
    "mac_roman>utf-8": lambda t: _decode_utf8("mac_roman", t),
    "cp1252>tcvn3": _decode_tcvn,
    "cp1252>tcvn3 words": _decode_tcvn_words,
}


def decode_runs(text: str) -> str:
    """``text`` with every stretch that is valid UTF-8 through Windows-1252 or Mac Roman decoded, as often as it is."""
    for codec in ("cp1252", "mac_roman"):
        if codec == "mac_roman" and not _MAC_SIGN.search(text):
            break
        for _ in range(MAX_STEPS):
            new = _decode_utf8(codec, text)
            if new == text:
                break
            text = new
    return text


def garbled_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches :func:`decode_runs` would decode, in order, overlapping ones joined."""
    found = []
    for codec in ("cp1252", "mac_roman"):
        if codec == "mac_roman" and not _MAC_SIGN.search(text):
            break
        at = _CODECS[codec]
        for m in _UTF8[codec].finditer(text):
            try:
                bytes(at[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MAC_SIGN = re.compile("[√ƒ∆]|·[ª∫]")


def chains(text: str) -> list[tuple[tuple[str, ...], str]]:
    """Every (chain of steps, decoded text), the empty chain first. A legacy step ends a chain and needs one of its odd characters in a word."""
    out = [((), text)]
    for chain, form in out:
        if len(chain) >= MAX_STEPS or (chain and chain[-1].startswith("cp1252>tcvn3")):
            continue
        for step, decode in STEPS.items():
            if step.startswith("cp1252>tcvn3") and not _TCVN_WORD.search(form):
                continue
            new = decode(form)
            if new != form and all(new != seen for _, seen in out):
                out.append(((*chain, step), new))
    return out


class Repairer:
    """Chooses for each line or sentence of a value the chain of least description length; see :func:`repair_encoding`."""

    def __init__(self, dictionaries: dict[str, bytes], step_bytes: dict[str, float] = STEP_BYTES):
        self.dictionaries, self.step_bytes, self.compressors = dictionaries, step_bytes, None
        self.length = lru_cache(maxsize=20_000)(self._length)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "step_bytes": self.step_bytes}

    def __setstate__(self, state):
        self.__init__(**state)

    def _length(self, text: str) -> int:
        if self.compressors is None:
            kinds = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries.values()]
            for d in kinds:
                d.precompute_compress(level=6)
            self.compressors = [zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False) for d in kinds] or [zstandard.ZstdCompressor(level=6)]
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.compressors)

    def repair(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, chains used, whether characters are lost for good)."""
        parts = _SEGMENT.split(text)
        options = {i: chains(parts[i]) for i in range(0, len(parts), 2) if parts[i]}
        options = {i: o for i, o in options.items() if len(o) > 1}
        used: dict[tuple[str, ...], None] = {}
        # the segment that gains most decides first; a chain once told is free for the others
        gains = {i: self.length(o[0][1]) - min(self.length(new) for _, new in o[1:]) for i, o in options.items()}
        for i in sorted(gains, key=gains.__getitem__, reverse=True):
            chain, parts[i] = min(options[i], key=lambda o: (self.length(o[1]) + (0 if o[0] in used else sum(self.step_bytes[s] for s in o[0])), o[0] not in used, len(o[0])))
            if chain:
                used[chain] = None
        new = "".join(parts)
        return new, ["|".join(c) for c in used], lost(new)


_SEGMENT = re.compile(r"(\n+|(?<=[^\W\d_][.;:!])\s+)")


def lost(text: str) -> bool:
    """Whether replacement characters stand where letters were: U+FFFD anywhere, or a question mark inside a word, before a lower-case one, or alone before one. Links are no evidence."""
    if "\ufffd" in text:
        return True
    if "?" not in text:
        return False
    for m in _LOST.finditer(text):
        if m.group()[-1] == "?" or m.group()[0] == "?":
            after = text[m.end() - 1 :].lstrip("? \t")[:1]
            if not after.islower():
                continue
        token = text[text.rfind(" ", 0, m.start()) + 1 : m.start()].rsplit("\n", 1)[-1] + text[m.start() :].split(None, 1)[0]
        if not _LINK.search(token):
            return True
    return False


def language_of(field):
    """'vi' where a value has Vietnamese letters, else 'en'."""
    return F.when(F.lower(field).rlike("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"), "vi").otherwise("en")


def train_dictionaries(df: DataFrame, fields: tuple[str, ...], id_col: str, rows: int = TRAIN_ROWS, size: int = DICT_BYTES) -> dict[str, dict[str, bytes]]:
    """Per field a zstandard dictionary of each language, trained on the clean ones of at most ``4 * rows`` values of a sample of ``rows`` ids.

    Values count as often as they occur. A language too rare for training gets its values as a raw dictionary.
    """
    sample = hash_sample(df, id_col, rows)
    out: dict[str, dict[str, bytes]] = {}
    for field in fields:
        value = F.col(field)
        clean = sample.where(value.isNotNull() & (F.length(value) > 8) & ~value.rlike(SUSPECT)).select(language_of(value).alias("language"), value.alias("value")).limit(4 * rows)
        own: dict[str, list[bytes]] = {}
        for language, text in clean.collect():
            own.setdefault(language, []).append(text.encode())
        out[field] = {language: _dictionary(sorted(texts), size) for language, texts in sorted(own.items())}
    return out


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 4)), texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def repair_encoding(df: DataFrame, fields: tuple[str, ...] = ("text", "source"), id_col: str = "chunk_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, field, original, restored, chains, lost) of every garbled value, one row per distinct value.

    Method: every candidate decoding, whole chains of them included, of each line or sentence is compressed with the zstandard
    dictionaries of the languages (one set per field); the chain with the least length, its own cost included, wins, and the unchanged text wins
    ties. ``lost`` says that replacement characters are left, which no chain can give back. Dictionaries are trained on a bounded
    sample of values without any suspicious character. A pattern over the whole Arrow column finds the values that may be garbled; only
    these become Python strings.

    Null and empty values give no row. No shuffle but that of the few garbled values, which drops equal rows.
    """
    trained = train_dictionaries(df, fields, id_col, train_rows)
    repairers = df.sparkSession.sparkContext.broadcast({f: Repairer(d) for f, d in trained.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for k, field in enumerate(fields, 1):
                at = matching(batch.column(k), _MAYBE)
                got = [repairers.value[field].repair(v) for v in batch.column(k).take(at).to_pylist()]
                mine = [i for i, (_, used, gone) in enumerate(got) if used or gone]
                if mine:
                    keep = at.take(pa.array(mine, pa.int64()))
                    yield [batch.column(0).take(keep), [field] * len(mine), batch.column(k).take(keep), [got[i][0] for i in mine], [got[i][1] for i in mine], [got[i][2] for i in mine]]

    return map_arrow(df.select(id_col, *fields), run, f"`{id_col}` {column_type(df, id_col)}, field string, original string, restored string, chains array<string>, lost boolean").distinct()


def restored_values(spark, sf_dir: str) -> DataFrame:
    """The garbled values in their original writing, as far as it can be told."""
    return repair_encoding(table(spark, sf_dir, "chunks")).select("chunk_id", "field", "restored", "lost")


def garbled_values(spark, sf_dir: str) -> DataFrame:
    return repair_encoding(table(spark, sf_dir, "chunks")).select("chunk_id", "field").distinct()
