"""Bytes behind base64 or hex that is wrapped, quoted or escaped in a text, read in linear time.

An encoded block is a sequence of runs of digits with separators that carry nothing between them: line ends, plain or
escaped, with the quotes, joining signs, comment and mail marks that stand around the lines of a quoted key; for hex also
colons, blanks and the prefixes of byte lists. A block is decoded once for each phase (where in a group of digits it begins),
so any number of starts inside it cost one pass.
"""

from __future__ import annotations

import binascii
import re
from bisect import bisect_right

_LINE_END = (
    r"""(?:\\++[rn])*+["']?[\x20\t]*+[+,.&\\]?[\x20\t]*+(?:\r\n?|\n)"""  # what ends a line
    r"""(?:[\x20\t]*+[>\#|*])*+[\x20\t]*+(?:[+,.&][\x20\t]*+(?=["']))?["']?"""  # what the next begins with
)
_WRAP = rf"{_LINE_END}|(?:\\++[rn]|%0[AaDd])++|\\++(?=/)"
_BASE64 = re.compile(rf"([A-Za-z0-9+/_-]++)|%2([BbFf])|(?:{_WRAP})")
_HEX = re.compile(rf"([0-9A-Fa-f]++)|(?!)()|(?::?(?:{_WRAP})(?:0[xX]|\\x)?|:|,?\x20?0[xX]|\\x|\x20)")
_STANDARD = str.maketrans("-_", "+/")
_PERCENT = {"b": "+", "f": "/"}


def from_base64(digits: str) -> bytes:
    """Whole groups and what a last group of two or three digits holds; a single last digit holds nothing."""
    digits = digits[: len(digits) - (len(digits) % 4 == 1)]
    return binascii.a2b_base64(digits + "=" * (-len(digits) % 4))


class Block:
    """The encoded block of `text` that begins at `at`."""

    def __init__(self, text: str, at: int, of_hex: bool = False):
        self.text, self.of_hex = text, of_hex
        self.group, self.size = (2, 1) if of_hex else (4, 3)  # digits of a group, bytes they hold
        self._text_at, self._joined_at, self._widths = [], [], []
        token, parts, joined, self.end = _HEX if of_hex else _BASE64, [], 0, at
        after_wrap = False
        while m := token.match(text, at):
            at = m.end()
            digits = m[1] or _PERCENT.get((m[2] or "").lower())
            if digits is None:
                if after_wrap:
                    break
                after_wrap = True
                continue
            after_wrap = False
            self._text_at.append(m.start())
            self._joined_at.append(joined)
            self._widths.append(1 if m[1] else 3)
            parts.append(digits)
            joined += len(digits)
            self.end = at
        self.digits = "".join(parts) if of_hex else "".join(parts).translate(_STANDARD)
        self._bytes: dict[int, bytes] = {}
        self.inner: dict[int, dict] = {}  # what a caller found in the bytes of each phase, read as a text

    def index(self, at: int) -> int:
        """Number of the digit that stands at `at` in the text."""
        k = bisect_right(self._text_at, at) - 1
        return self._joined_at[k] + (at - self._text_at[k]) // self._widths[k]

    def line_end(self, at: int) -> int:
        """Number of the digit after the unbroken run that `at` lies in."""
        k = bisect_right(self._text_at, at)
        return self._joined_at[k] if k < len(self._joined_at) else len(self.digits)

    def bytes_at(self, index: int) -> tuple[bytes, int]:
        """Bytes of the phase of that digit, and which of them begins there."""
        phase = index % self.group
        if phase not in self._bytes:
            digits = self.digits[phase:]
            self._bytes[phase] = bytes.fromhex(digits[: len(digits) // 2 * 2]) if self.of_hex else from_base64(digits)
        return self._bytes[phase], index // self.group * self.size

    def digit_after(self, index: int, size: int) -> int:
        """Number of the digit after `size` bytes that begin at digit `index`."""
        return index + -(-size * self.group // self.size)

    def text_end(self, after: int) -> int:
        """Where in the text the digit before number `after` ends."""
        k = bisect_right(self._joined_at, after - 1) - 1
        return self._text_at[k] + (after - self._joined_at[k]) * self._widths[k]
