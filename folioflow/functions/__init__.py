"""Column builders: text, validators, coercion of untrusted JSON."""
