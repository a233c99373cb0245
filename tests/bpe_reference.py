"""A plain one-at-a-time trainer that the Spark trainer is checked against."""

from wordloom.operators.bpe import ALL_BYTES, SPECIAL_TOKENS, BpeModel


def train_bpe_local(word_counts: dict[str, int], vocab_size: int, min_frequency: int = 2,
                    alphabet: str = "full", special_tokens: list[str] | None = None) -> BpeModel:
    """One merge at a time, same tie-break; used to check the Spark trainer."""
    specials = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    words = {tuple(f"{b:02X}" for b in t.encode("utf-8")): n for t, n in word_counts.items()}
    if alphabet == "full":
        alpha = list(ALL_BYTES)
    else:
        alpha = sorted({s for w in words for s in w})
    model = BpeModel(specials, alpha, [], [])
    tokens = set(alpha)
    budget = vocab_size - len(specials) - len(alpha)
    while budget > 0:
        counts: dict[tuple[str, str], int] = {}
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                counts[(a, b)] = counts.get((a, b), 0) + n
        if not counts:
            break
        (a, b), c = min(counts.items(), key=lambda kv: (-kv[1], kv[0][0] + " " + kv[0][1]))
        if c < min_frequency:
            break
        model.merges.append((a, b))
        model.merge_counts.append(c)
        if a + b not in tokens:
            tokens.add(a + b)
            budget -= 1
        new_words: dict[tuple[str, ...], int] = {}
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            t = tuple(out)
            new_words[t] = new_words.get(t, 0) + n
        words = new_words
    return model

