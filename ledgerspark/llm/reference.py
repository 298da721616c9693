"""Plain helpers for the brute-force versions that tests compare with."""

import re


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)
