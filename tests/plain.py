"""The semantics in plain Python, tried out edit by edit. Used to check the Spark jobs."""

import re

SUB = (5, 4, 3, 2, 1)
INDEL = (10, 8, 6, 4, 2)


def normalize(text):
    text = re.sub(r"\s+", " ", text.lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", "", text)).strip()


def penalty(table, position):
    return table[min(position, 5) - 1]


def edited_texts(query, alphabet):
    """Every (text, score) one edit or none can give."""
    size = len(query)
    yield query, 2 * size
    for i in range(1, size + 2):
        for letter in alphabet:
            yield query[: i - 1] + letter + query[i - 1 :], 2 * size - penalty(INDEL, i)
    for i in range(1, size + 1):
        for letter in alphabet:
            if letter != query[i - 1]:
                yield query[: i - 1] + letter + query[i:], 2 * (size - 1) - penalty(SUB, i)
        yield query[: i - 1] + query[i:], 2 * (size - 1) - penalty(INDEL, i)


def ladder(query, alphabet):
    best = {}
    for text, score in edited_texts(query, alphabet):
        if text and score > 0 and "  " not in text:
            best[text] = max(score, best.get(text, 0))
    return best


def best_scores(query, lines, alphabet):
    """{line: best score} over all lines that match."""
    found = {}
    for text, score in ladder(query, alphabet).items():
        for number, line in enumerate(lines):
            if text in line:
                found[number] = max(score, found.get(number, 0))
    return found


def best_k(query, lines, alphabet, k):
    found = best_scores(query, lines, alphabet)
    return sorted(((-score, number) for number, score in found.items()))[:k]
