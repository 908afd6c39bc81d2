"""Column functions: numeric encodings of masses, intensities and bit patterns."""
