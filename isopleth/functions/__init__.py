"""Units, constants and scalar expressions."""
