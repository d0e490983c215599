"""What is sequential within one image, in numpy: palettes, label maps, boundary walks, curve fits, centrelines.

These functions see one image (or one region) at a time and run inside grouped Arrow functions; all
that can be said about pixels as a relation is in ``operators``.
"""
