"""Part of sprachwerk."""
