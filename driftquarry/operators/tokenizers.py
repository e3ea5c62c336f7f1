"""Whether teacher and student read text alike: hashes, differences, and probes that are encoded by both."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

SPECIAL = ("bos_token_id", "eos_token_id", "pad_token_id", "unk_token_id")
#: Prose, code, accents and other scripts, marks of chats and tools, white space.
PROBES = (
    "Twelve boxing wizards jump quickly; 3.14 and 2,718.",
    "for (i, x) in rows {\n\treturn x ** 2; // twice\n}\n",
    "Ça va? Größe, naïve, 数学と物理, Привет",  # ascii-exempt
    "<|user|><think>a</think><tool>{\"k\": [1, 2]}</tool>",
    "  two  spaces,\ttabs\t and an end ",
)


@dataclass(frozen=True)
class Tokenizer:
    """A user's tokenizer: tokens by id, a function from text to ids (without special tokens), and special ids."""

    tokens: Sequence[str]
    encode: Callable[[str], Sequence[int]]
    special: dict[str, int | None] = field(default_factory=dict)
    vocab_size: int | None = None

    def hash(self) -> str:
        """Of what encoding depends on, not of a file's bytes: size, each id's token, special ids."""
        h = hashlib.sha256(f"vocab_size={self.vocab_size or len(self.tokens)}\n".encode())
        for i, token in enumerate(self.tokens):
            h.update(f"{i}\t{token}\n".encode("utf-8", "replace"))
        for name in SPECIAL:
            h.update(f"{name}={self.special.get(name)}\n".encode())
        return h.hexdigest()


def differences(teacher: Tokenizer, student: Tokenizer) -> list[str]:
    """What differs in size and special ids, as text."""
    pairs = [("vocab_size", teacher.vocab_size or len(teacher.tokens), student.vocab_size or len(student.tokens)), *[(n, teacher.special.get(n), student.special.get(n)) for n in SPECIAL]]
    return [f"{name}: {a} and {b}" for name, a, b in pairs if a != b]


def parity(teacher: Tokenizer, student: Tokenizer) -> tuple[bool, tuple[str, list[int], list[int]] | None]:
    """Whether both encode all probes to the same ids, and the first that differs with both results. An encoder that fails differs."""
    for probe in PROBES:
        try:
            a, b = list(teacher.encode(probe)), list(student.encode(probe))
        except Exception as e:
            return False, (f"{probe!r}: {e}", [], [])
        if a != b:
            return False, (probe, a, b)
    return True, None


def compared(teacher: Tokenizer | None, student: Tokenizer | None, mode: str, forced: bool = False) -> dict:
    """The `tokenizer` object of a record. Without both tokenizers nothing was checked, and it says so with nulls."""
    if teacher is None or student is None:
        return {"mode": mode, "identical": None, "encoding_parity": None, "forced": forced, "diffs": ["not checked"]}
    same = teacher.hash() == student.hash()
    alike, where = (True, None) if same else parity(teacher, student)
    diffs = differences(teacher, student) + ([f"{where[0]!r} is encoded otherwise"] if where else [])
    return {"mode": mode, "identical": same, "encoding_parity": alike, "forced": forced and not alike, "diffs": diffs}


def stream_status(cached: str | None, own: str | None, mode: str) -> tuple[bool | None, str | None]:
    """Whether a cached token stream is the one that the student's tokenizer makes (null if either isn't known), and a warning if not."""
    if cached is None or own is None:
        return None, None
    if cached == own:
        return True, None
    advice = {"synthesized": "rebuild the entry to score on the student's own tokens, or borrow the teacher's tokenizer on purpose", "borrowed": "a borrowed tokenizer should give the teacher's stream: check its version"}
    return False, f"the entry replays tokens ({cached}) that the student's tokenizer doesn't make ({own}); {advice.get(mode, 'rebuild the entry to score on its own tokens')}"
