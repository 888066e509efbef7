"""Plain versions of operators that several tests compare with."""
import xxhash


def reference_fingerprint(text):
    words, now = [], ""
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")):
        if ch in " \t\n\x0b\x0c\r":
            words, now = words + ([now] if now else []), ""
        else:
            now += ch
    words += [now] if now else []
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """id -> smallest reachable id, for {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                hi, lo = sorted((find(a), find(b)), reverse=True)
                root[hi] = lo
    return {i: find(i) for i in ids}
