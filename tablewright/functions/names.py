"""Column names in expressions."""


def quoted(name: str) -> str:
    """The name as one identifier, whatever characters it has."""
    escaped = name.replace("`", "``")
    return f"`{escaped}`"
