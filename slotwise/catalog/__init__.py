"""Part of slotwise; see the package README."""
