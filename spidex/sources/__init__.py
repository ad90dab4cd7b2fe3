"""Where tables come from, and the seams for what a network would give."""
