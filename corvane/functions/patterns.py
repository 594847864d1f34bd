"""Character classes whose matches equal Python's, written so that Java and RE2 read them alike."""

# The code points that Python's \s matches.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Python's \w, but for code points that are newer than the JVM.
WORD = r"[\p{L}\p{N}_]"

#: The same code points as characters, for trim().
WS_CHARACTERS = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

# The plain patterns, which are what is meant. The JVM_ forms below match the same, faster in Java: they start at word
# starts only, never give back what they took, and leave single spaces alone.
DEHYPHENATE = rf"({WORD}+)-{WS}+({WORD}+)"
SPACES = rf"{WS}+"
BEFORE_PUNCTUATION = rf"{WS}+([,.;:!?])"
AFTER_OPEN = rf"\({WS}+"
BEFORE_CLOSE = rf"{WS}+\)"
ENDS = rf"^{WS}+|{WS}+$"
BEFORE_NEWLINE = rf"{WS}+\n"
_OTHER_WS = WS.replace(r"-\x20", r"-\x1f")
JVM_DEHYPHENATE = rf"(?<!{WORD})({WORD}++)-{WS}++({WORD}++)"
JVM_MAY_DEHYPHENATE = rf"-{WS}"
JVM_SPACES = rf"{WS}{{2,}}+|{_OTHER_WS}"
JVM_BEFORE_PUNCTUATION = rf"{WS}++([,.;:!?])"
JVM_BEFORE_CLOSE = rf"{WS}++\)"
# The year in a publisher's line, and what comes before the authors.
YEAR = rf"([0-9]{{4}}){WS}*г\."
AUTHOR_MARK = "Автор(ы):"
