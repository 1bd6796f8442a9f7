"""Setting signs apart and dropping comments, in plain Python; literals are one unit."""

import re
from itertools import chain

#: Signs that are set apart by blanks, longer ones first where they share a start.
SIGNS = (
    ";", r"\(", r"\)", r"[-+*/%]=", "->", r"\+\+", r"\+", "--", "-", r"\*\*", r"\*", "//", "/", "%", r"\{", r"\}", "[<>=!][<>=]", "[<>=]",
    "!", r"\^", "&&", "&", r"\|\|", r"\|", "::", ":", ",",
)
#: Text that stays as it is (a literal with escapes, or what stands between two apostrophes on one line).
DOUBLE, SINGLE = r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"", r"'.+?'"
SIGN = re.compile("|".join(SIGNS))
#: A comment, or a literal that hides one (character literals with escapes too).
COMMENTS = re.compile(r"//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\"", re.S | re.M)


def _hide(code: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with every literal replaced by one character that it does not hold, and the literals.

    Every occurrence of a literal goes, wherever it stands; literals in double quotes first."""
    hidden: list[str] = []
    marks = (chr(c) for c in chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE)) if chr(c) not in code)
    names: list[str] = []
    for pattern in (DOUBLE, SINGLE):
        for literal in re.findall(pattern, code):
            if literal in code:
                names.append(next(marks))
                code = code.replace(literal, names[-1])
                hidden.append(literal)
    return code, list(zip(names, hidden, strict=True))


def pad_code(code: str | None) -> str | None:
    """Signs set apart by single blanks, runs of white space made one, literals untouched."""
    if code is None:
        return None
    text, hidden = _hide(code)
    text = " ".join(SIGN.sub(lambda m: f" {m[0]} ", text).replace("<>", "< >").split())
    for name, literal in hidden:
        text = text.replace(name, literal)
    return text


def strip_comments(code: str | None) -> str | None:
    """Comments become a blank, literals stay, blank lines go."""
    if code is None:
        return None
    text = COMMENTS.sub(lambda m: " " if m[0].startswith("/") else m[0], code)
    return "\n".join(line for line in text.split("\n") if line.strip())
