"""DataFrame operators; each takes a DataFrame and returns one."""
