"""Plan building blocks that keep hot groups distributed."""
