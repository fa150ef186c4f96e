"""Parts of a physical plan's text."""


def below(df, node):
    """The subtree under every plan node whose name holds ``node``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if node in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out
