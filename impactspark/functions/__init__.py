"""Part of impactspark."""
