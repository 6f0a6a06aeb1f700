"""Part of varloom."""
