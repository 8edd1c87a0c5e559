"""Exchange of array blocks as a stream of epochs."""
