"""The same transformations over streams (an extension)."""
