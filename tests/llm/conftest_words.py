"""Words of invented languages."""

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel", "sun"], "bb": ["sch", "ung", "ver", "keit", "lich"], "cc": ["eau", "oi", "que", "ment", "ère"]}


def languages(rng, lang, n):
    own = SYLLABLES[lang]
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))
