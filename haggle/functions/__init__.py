"""Column-level helpers: repeatable hashing uniforms, text parsing and
skew-safe running scans."""
