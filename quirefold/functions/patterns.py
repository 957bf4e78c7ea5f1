"""Character classes that mean the same in Java's and RE2's regular expressions."""

from __future__ import annotations

#: White space, as str.isspace has it.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
NOT_WS = f"[^{SPACE}]"
#: The same characters as a string, for trimming.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The line ends of str.splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
#: Characters of words, and a border of a word on the left and on the right.
WORD = r"[\p{L}\p{N}_]"
LEFT = r"(?<![\p{L}\p{N}_])"
RIGHT = r"(?![\p{L}\p{N}_])"
