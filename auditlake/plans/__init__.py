"""Plans that compose operators, and the skew-safe building blocks they share."""
