"""Part of reelmark."""
