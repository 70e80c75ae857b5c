"""Column functions: key, size, hash and checksum helpers."""
