"""Plain helpers of the tests in this folder."""


def components_of(n, links):
    """Smallest reachable number of each of n, by a plain union of sets."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(int(a)), root(int(b))
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
